"""Linear hinge-loss model by dual coordinate descent, and a calibration of its margins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm.common import held_out

#: Bytes of labelled text that a fit takes to the driver at most. Rows are taken whole, in a seeded order, up to this sum.
FIT_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text", seed: int = 5, fit_bytes: int = FIT_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(d, text, y) of about `most` rows of each class, in the order of a seeded hash of the id while their texts stay within
    `fit_bytes` together, and the classes' sizes.

    Rows that are held out, null labels, null ids and null texts are left out; of repeated labels of an id the highest
    counts; rows repeated in full count once, and rows of one id with different texts each. However many rows an id has, at
    most 2.4 x most rows come to the driver."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    own = own.groupBy(F.col(doc_id).alias("k")).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / n))).otherwise(share)
    mark = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1_000_000)) / 1_000_000
    # At most 2.4 x most rows of two numbers each, by the limit; the rule above rarely comes near it.
    limit = int(2.4 * most)
    picked = own.where(mark < share).orderBy(F.xxhash64(F.lit(seed), "k")).limit(limit)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    rows = rows.join(F.broadcast(picked), F.col("d") == F.col("k"))
    found = rows.select("d", "h", "n", "y").distinct().orderBy(F.xxhash64(F.lit(seed), "d"), "d", "h").limit(limit).toArrow()
    within = np.cumsum(found.column("n").to_numpy(), dtype=np.int64) <= fit_bytes
    chosen = found.slice(0, int(within.sum())).select(["d", "h", "y"])
    schema = T.StructType([T.StructField("k", docs.schema[doc_id].dataType), T.StructField("g", T.LongType()), T.StructField("y", T.IntegerType())])
    # From Arrow: a list would be turned into rows by Python workers of another kind, which stay beside those of the queries.
    few = docs.sparkSession.createDataFrame(chosen.rename_columns(["k", "g", "y"]), schema)  # 2.4 x most rows at most
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    return texts.join(F.broadcast(few), (F.col("d") == F.col("k")) & (F.col("h") == F.col("g"))).select("d", "h", "text", "y").dropDuplicates(["d", "h"]), sizes


def fit_hinge(start: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, c: np.ndarray, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + sum c_i max(0, 1 - y_i w x_i), one dual variable at a time."""
    n = len(y)
    w = np.zeros(size + 1)
    alpha = np.zeros(n)
    square = np.add.reduceat(np.concatenate((value**2, [0.0])), start[:-1])[:n] * (np.diff(start) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            x, v = index[start[i] : start[i + 1]], value[start[i] : start[i + 1]]
            g = y[i] * (w[x] @ v + w[size]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[x] += d * v
                w[size] += d
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a m + b) by Newton steps on the weighted log loss with smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(v):
        z = v[0] * margin + v[1]
        return (weight * (np.logaddexp(0, z) - t * z)).sum() + 5e-4 * (v[0] - 1) ** 2

    v = np.array([1.0, float(np.log((pos + 1) / (neg + 1)))])
    now = loss(v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * margin + v[1], -35, 35)))
        d, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * (v[0] - 1), d.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        # Full steps overshoot where classes lie apart: they are halved until the loss falls.
        for _ in range(40):
            new = loss(v - step)
            if new <= now:
                break
            step = step / 2
        else:
            break
        v, done = v - step, now - new < 1e-9 * max(1.0, now)
        now = new
        if done:
            break
    return float(v[0]), float(v[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()
