"""Packing by minimum bin slack: bitset subset sums choose, window by window, the remaining lengths that fill it best."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm.common import cut, steps, text_bytes, trimmed

#: Rows of a stored file that are ranked together: a length, however frequent, is ranked block by block.
BLOCK = 1 << 16
FIELDS = ["start", "length", "ids_crc32", "doc_tokens"]


def pieces(docs: DataFrame, tokenizer: str, window: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: a document's ids and a final id 0, cut every `window` ids. text_hash tells texts of one id apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text_hash", T.LongType()), *[T.StructField(f, T.LongType()) for f in FIELDS]])

    def run(batches):
        from paperweir.llm.pretoken import Encoder

        encode = Encoder(tokenizer)
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in steps(offsets):
                o = offsets[lo : hi + 1]
                ids, n = encode.ids_of(data[o[0] : o[-1]], o - o[0])
                total = n + 1
                flat = np.zeros(int(total.sum()), "<u4")
                ends = np.cumsum(total)
                room = np.ones(len(flat), bool)
                room[ends - 1] = False
                flat[room] = ids
                parts = -(-total // window)
                owner = np.repeat(np.arange(hi - lo), parts)
                start = window * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
                length = np.minimum(window, total[owner] - start)
                at = (ends - total)[owner] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                own = [batch.column(c).slice(lo, hi - lo).take(pa.array(owner)) for c in (0, 2)]
                arrays = [*own, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[owner])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", *FIELDS])

    return rows.mapInArrow(run, schema)


def _powers(window: int) -> set[int]:
    return {window} | {1 << i for i in range(window.bit_length())}


def fill(counts: dict[int, int], first: int, window: int) -> dict[int, int]:
    """Which lengths, and how many of each, join `first` in a window with least padding; larger fills win ties.

    The set of reachable sums is an integer's bits; each count is taken in doublings, and the way back follows them."""
    trail, bits = [], 1
    room = window - first
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        k = 1
        while left > 0:
            k = min(k, left)
            trail.append((length, k, bits))
            bits |= (bits << (length * k)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    free = _powers(window)
    best = min((s for s in range(room + 1) if bits >> s & 1), key=lambda s: (0 if first + s in free else window - first - s, -s))
    chosen = {first: 1}
    for length, k, before in reversed(trail):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + k
            best -= length * k
    return chosen


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) until all pieces are placed. Each pattern is used as long as its lengths last, so that the
    number of patterns depends on the window and not on the number of pieces."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        chosen = fill(left, max(left), window)
        times = min(left[k] // v for k, v in chosen.items())
        out.append((times, chosen))
        for k, v in chosen.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


def cuts(chosen: dict[int, int], window: int) -> tuple[dict[int, list[list[tuple[int, int, int, int]]]], int]:
    """For each length of a pattern, and each of its pieces there, (start, length, sequence, offset) of its parts; and the number
    of sequences. One sequence if what the pattern holds needs no padding, else one for each power of two that it is made of."""
    size = sum(k * v for k, v in chosen.items())
    rooms = [size] if size in _powers(window) else [1 << i for i in reversed(range(window.bit_length())) if size >> i & 1]
    out: dict[int, list[list[tuple[int, int, int, int]]]] = {}
    room, at = 0, 0
    for k, v in sorted(chosen.items(), reverse=True):
        for _ in range(v):
            parts, taken = [], 0
            while taken < k:
                step = min(k - taken, rooms[room] - at)
                parts.append((taken, step, room, at))
                taken, at = taken + step, at + step
                if at == rooms[room]:
                    room, at = room + 1, 0
            out.setdefault(k, []).append(parts)
    return out, len(rooms)


class Places:
    """Where each piece goes, by its length and its rank among pieces of this length. Held per pattern, not per piece."""

    def __init__(self, counts: dict[int, int], window: int):
        self.ranges: dict[int, list[tuple[int, int, int, list]]] = {k: [] for k in counts}
        used, seq = dict.fromkeys(counts, 0), 0
        for times, chosen in plan(counts, window):
            parts, rooms = cuts(chosen, window)
            for k, v in chosen.items():
                # From rank used[k] on, v pieces to a use of the pattern, which takes `rooms` sequences from `seq` on.
                self.ranges[k].append((used[k], seq, rooms, parts[k]))
                used[k] += times * v
            seq += times * rooms
        self.first = {k: np.array([r[0] for r in v], np.int64) for k, v in self.ranges.items()}

    def of(self, length: int, rank: np.ndarray):
        """(which of the ranks, start, length, sequence, offset) of every part of the pieces, and which pieces are cut."""
        hit = np.searchsorted(self.first[length], rank, "right") - 1
        found, is_cut = [], np.zeros(len(rank), bool)
        for j in np.unique(hit).tolist():
            low, seq, rooms, parts = self.ranges[length][j]
            i = np.flatnonzero(hit == j)
            times, which = (rank[i] - low) // len(parts), (rank[i] - low) % len(parts)
            for p, pieces_of in enumerate(parts):
                own = which == p
                is_cut[i[own]] = len(pieces_of) > 1
                for start, step, room, at in pieces_of:
                    n = int(own.sum())
                    found.append((i[own], np.full(n, start), np.full(n, step), seq + times[own] * rooms + room, np.full(n, at)))
        return tuple(np.concatenate(c) for c in zip(*found)), is_cut


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset: sequences of at most `window` ids.

    Full pieces are sequences of their own; the rests of documents are packed by least slack, where a sequence of a power of
    two needs no padding. Pieces of patterns in which padding would remain are cut at powers of two instead. The driver holds
    a count per length and a few numbers per pattern, both bounded by the window; pieces are placed by their rank, so that a
    million pieces of one length cost what one does. A piece is told apart by its place in the stored table, so that rows
    equal in full rank like any others. Ids may be of any type. Null or empty texts are the id 0 alone; an empty table has no
    pieces; repeated rows are packed each; null ids stay null; texts of any length are encoded whole; other columns are not
    looked at; ties between lengths go to the longer.
    """
    stored = cut(pieces(docs, tokenizer, window, doc_id, text))
    # Spark's writer names its files part-<task>-<id>-c<file of the task>.
    task, file = (F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2))
    block = F.shiftleft(task, 40).bitwiseOR(F.shiftleft(file, 26)).bitwiseOR(F.floor(F.col("_metadata.row_index") / BLOCK))
    stored = stored.select("*", block.alias("block"), F.col("_metadata.row_index").alias("row"))
    sizes = cut(stored.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(counts, window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "block", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1
    ranked = stored.withColumn("inner", inner).join(bases, ["length", "block"]).select("doc_id", "text_hash", *FIELDS, (F.col("base") + F.col("inner")).alias("rank"))
    fields = [stored.schema["doc_id"], T.StructField("text_hash", T.LongType()), *[T.StructField(f, T.LongType()) for f in (*FIELDS, "sequence_id", "offset", "whole_start")]]

    def place(batches):
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            start, length, rank = (batch.column(c).to_numpy() for c in (2, 3, 6))
            for k in np.unique(length).tolist():
                i = np.flatnonzero(length == k)
                (j, a, n, seq, at), is_cut = places.of(k, rank[i])
                j, again = i[j], is_cut[j]
                crc = pa.array(batch.column(4).to_numpy()[j], mask=again)  # of a part it is not known yet
                arrays = [batch.column(0).take(pa.array(j)), batch.column(1).take(pa.array(j)), pa.array(start[j] + a), pa.array(n), crc, batch.column(5).take(pa.array(j)), pa.array(seq), pa.array(at), pa.array(start[j])]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    placed = ranked.mapInArrow(place, T.StructType(fields))
    result = ["doc_id", *FIELDS, "sequence_id", "offset"]
    if not any(len(p) > 1 for v in places.ranges.values() for _, _, _, parts in v for p in parts):
        return placed.select(*result)
    placed = cut(placed)
    again = _checksums(docs, tokenizer, placed.where("ids_crc32 is null"), doc_id, text)
    return placed.where("ids_crc32 is not null").select(*result).unionByName(again.select(*result))


def _checksums(docs: DataFrame, tokenizer: str, parts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """parts with ids_crc32: texts that have any are encoded once more, each with a bounded number of its parts."""
    texts = docs.select(F.col(doc_id).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("g"), F.col(text).alias("text"))
    keys = parts.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).distinct()
    # Rows of one id and text have the same ids: one of them serves all.
    texts = texts.join(keys, F.col("k").eqNullSafe(F.col("own_id")) & (F.col("g") == F.col("own_hash")), "left_semi").dropDuplicates(["k", "g"])
    same = F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("text_hash"))
    names = ["doc_id", *FIELDS, "sequence_id", "offset"]
    fields = [parts.schema[c] for c in names]

    def run(batches):
        from paperweir.llm.pretoken import Encoder

        encode = Encoder(tokenizer)
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(7))
            start, length = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi in steps(offsets):
                o = offsets[lo : hi + 1]
                ids, n = encode.ids_of(data[o[0] : o[-1]], o - o[0])
                ends = np.cumsum(n)
                crc = []
                for i in range(hi - lo):
                    own = np.append(ids[ends[i] - n[i] : ends[i]], 0).astype("<u4")
                    crc.append(zlib.crc32(own[start[lo + i] : start[lo + i] + length[lo + i]].tobytes()))
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(0), part.column(1), part.column(2), pa.array(crc, pa.int64()), part.column(4), part.column(5), part.column(6)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts.join(parts, same).select(*names, "text").mapInArrow(run, T.StructType(fields))
