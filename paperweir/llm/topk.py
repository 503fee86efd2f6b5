"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweir.llm.common import cut

#: Vectors of a leaf and of a shard, queries broadcast at a time, and vectors whose scores give the first bounds.
LEAF, SHARD, BLOCK, SAMPLE = 64, 8192, 20_000, 4096
#: The score of a place that is not taken.
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): rows whose id is set and whose vector has only finite components."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def whole(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """floor(256 x) of the vectors, by their length: [(rows, matrix)]. Each is a whole number, held exactly."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * 256)
    start = np.cumsum(size) - size
    return [(i, flat[start[i][:, None] + np.arange(d)]) for d in np.unique(size).tolist() for i in (np.flatnonzero(size == d),)]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products. Floating point serves while no sum can reach 2**53; beyond that Python's integers do, and what is
    beyond 64 bits becomes the nearest number that is not."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole_numbers = np.vectorize(int, otypes=[object])
    exact = whole_numbers(q) @ whole_numbers(x).T if q.size and x.size else np.zeros((len(q), len(x)), object)
    return np.clip(exact, NONE + 1, -(NONE + 1)).astype(np.int64)


class BallTree:
    """Nodes are ranges of `order`, each with a centre and a radius; children split at the median of the widest component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, np.ndarray, float, list[int]]] = []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = self.x[self.order[lo:hi]]
            centre = own.mean(0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(1).max())) if len(own) else 0.0
            k = len(self.nodes)
            self.nodes.append((lo, hi, centre, radius, []))
            if parent >= 0:
                self.nodes[parent][4].append(k)
            if hi - lo > LEAF:
                j, mid = int((own.max(0) - own.min(0)).argmax()), (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, j], mid)]
                todo += [(lo, lo + mid, k), (lo + mid, hi, k)]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray) -> None:
        """Merges this shard's vectors into scores and found (rows sorted by score, then id) by branch and bound.

        A node's upper bound is q . centre + |q| radius, with room for rounding. A query goes down only where that reaches its
        kth score, the child of the higher bound first; what it finds there is its bar for the other child."""
        length = np.sqrt((q**2).sum(1))

        def reach(node: int, who: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _ = self.nodes[node]
            bound = q[who] @ centre + length[who] * radius
            return bound + 1e-6 * (1 + np.abs(bound) + length[who] * (radius + np.sqrt((centre**2).sum())))

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            who = who[bound >= scores[who, k - 1]]
            if not len(who):
                return
            lo, hi, _, _, children = self.nodes[node]
            if children:
                a, b = (reach(c, who) for c in children)
                for side, first, second in ((a >= b, 0, 1), (a < b, 1, 0)):
                    if side.any():
                        visit(children[first], who[side], (a, b)[first][side])
                        visit(children[second], who[side], (a, b)[second][side])
                return
            members = np.sort(self.order[lo:hi])
            s = products(q[who], self.x[members])
            s[q_ids[who][:, None] == self.ids[members][None, :]] = NONE
            better = (s >= scores[who, k - 1][:, None]).any(1)
            who, s = who[better], s[better]
            if len(who):
                all_s = np.concatenate((scores[who], s), 1)
                all_i = np.concatenate((found[who], np.broadcast_to(self.ids[members], s.shape)), 1)
                best = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                scores[who] = np.take_along_axis(all_s, best, 1)
                found[who] = np.take_along_axis(all_i, best, 1)

        if len(self.ids):
            everyone = np.arange(len(q))
            visit(0, everyone, reach(0, everyone))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(256 x), ties to the smaller id.

    Every batch of a partition is a shard with a tree of its own; a task carries each query's kth score from shard to shard,
    and starts from the kth scores over a bounded sample. Queries are broadcast in blocks of about BLOCK; of several, each is
    stored before the next one's is sent, and its broadcast goes. A query's own id is no candidate; only vectors of the
    query's length are; vectors that are null or hold null or non-finite components take no part; of a query id's repeated
    rows the smallest vector asks; repeated candidates each count; scores are exact, and beyond 64 bits stand as the nearest
    number within; an empty table on either side gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    asked = usable(queries, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    # At most SAMPLE rows.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        sets = []
        sample_ids, q_ids = sample.column("id").to_numpy(), block.column("id").to_numpy()
        seeds = {m.shape[1]: (sample_ids[i], m) for i, m in whole(sample.column("v"))}
        for i, m in whole(block.column("v")):
            scores, found = np.full((len(i), k), NONE), np.full((len(i), k), np.iinfo(np.int64).max)
            if m.shape[1] in seeds:
                BallTree(*seeds[m.shape[1]]).search(q_ids[i], m, k, scores, found)
            sets.append((q_ids[i], m.astype(np.float64), scores[:, k - 1].copy()))
        shared = spark.sparkContext.broadcast(sets)

        def run(batches, shared=shared):
            state = {m.shape[1]: (ids, m, np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max), floor) for ids, m, floor in shared.value}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for i, m in whole(batch.column(1)):
                    if m.shape[1] not in state:
                        continue
                    q_ids, q, scores, found, floor = state[m.shape[1]]
                    for at in range(0, len(i), SHARD):
                        tree = BallTree(ids[i[at : at + SHARD]], m[at : at + SHARD])
                        for lo in range(0, len(q), 2048):
                            hi = min(lo + 2048, len(q))
                            # The bound known from the sample stands in while fewer than k are found here.
                            held = np.where(scores[lo:hi] == NONE, floor[lo:hi][:, None], scores[lo:hi])
                            f = found[lo:hi]
                            tree.search(q_ids[lo:hi], q[lo:hi], k, held, f)
                            scores[lo:hi] = np.where(f == np.iinfo(np.int64).max, NONE, held)
            for q_ids, _, scores, found, _ in state.values():
                r, c = np.nonzero(scores > NONE)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(found[r, c]), pa.array(scores[r, c])], names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        if blocks > 1:
            part = cut(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

