"""Suffix-array dedup: bytes under a string of `width` bytes that starts twice anywhere are found and removed.

Texts are cut into windows of `width` bytes by content: a window belongs to the anchor that is the least of its 64-byte
hashes, so equal windows have equal anchors wherever they stand. Anchors that occur once rule out all their windows. The
contexts of the others go to shards by anchor; in a shard, induced sorting puts all suffixes of the distinct contexts in
order, and neighbours that share `width` bytes are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import Scratch, cut, lists, steps, text_bytes, trimmed
from paperweir.llm.induced import suffix_order

U = K.U
#: Bytes of a gram; occurrences from which an anchor counts as hot; windows per part of a hot anchor; bytes sorted at once,
#: and of these what bucket queues hold in memory (a position takes 4 bytes; the rest is on the task's disk).
GRAM, HOT, PART, SHARD_BYTES, QUEUE_BYTES = 64, 256, 4, 4 << 20, 8 << 20
#: An anchor with more than one in SPREAD of all rows, and more than LEAST, is joined in as many parts as it exceeds that by.
SPREAD, LEAST = 2000, 4096
#: Entries that a task remembers in order not to send equal texts and contexts again; beyond it forgets them and sends on.
REMEMBERED = 1_000_000
#: Neighbours in suffix order whose common prefixes are tested at a time.
COMPARED = 1 << 18
_OTHER_BASE = 0xD6E8FEB86659FD93


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on; k is a power of two from 8 on."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    h, n = K.mix(np.ndarray((len(data),), "<u8", padded, strides=(1,))), 8
    while n < k and len(h) > n:
        h = K.mix(h[:-n] * U(0x9E3779B97F4A7C15) + h[n:])
        n *= 2
    return h[: max(0, len(data) - k + 1)]


def anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """(row, first window, number of windows, anchor's place after the first window, anchor's hash) of each run of windows
    that share an anchor; every window inside a row lies in one run. Of equal hashes the leftmost is the anchor."""
    n = len(data) - width + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, z, np.zeros(0, U)
    h = _grams(data, GRAM)
    bits = U(max(1, int(len(data)).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=U)
    span, m, k = width - GRAM + 1, key, 1
    while k * 2 <= span:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < span:
        m = np.minimum(m[: len(key) - span + 1], m[span - k : span - k + len(key) - span + 1])
    place = (m & ((U(1) << bits) - U(1))).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
    inside = np.arange(n) + width <= offsets[row + 1]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1]))))
    count = np.diff(np.concatenate((first, [n])))
    ok = inside[first]
    first, count = first[ok], count[ok]
    return row[first], first, count, place[first] - first, h[place[first]]


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """(h, t, u, p) per run, of texts (t, u, text); p packs first window, windows and the anchor's place."""

    def run(batches):
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(2))
            t, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in steps(offsets):
                o = offsets[lo : hi + 1]
                row, first, count, place, h = anchors(data[o[0] : o[-1]], o - o[0], width)
                p = (first - (o[row] - o[0])) << 16 | count << 8 | place
                arrays = [pa.array(h.view(np.int64)), pa.array(t[lo:hi][row]), pa.array(u[lo:hi][row]), pa.array(p)]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "t", "u", "p"])

    return texts.mapInArrow(run, "h long, t long, u long, p long")


_CONTEXT = "key long, c long, d long, t long, u long, s long, w int, ctx binary"


def _context_rows(found: DataFrame, width: int) -> DataFrame:
    """One row per run of a repeated anchor, with its context's bytes at most twice per task; and each text once (key null).

    A hot anchor's runs are cut into parts of PART windows, keyed also by the bytes that all of a part's windows share."""

    def split_hot(text, s, w, place, key, hot):
        cold = ~hot
        a = (s + place)[hot]
        # Window s of anchor a is number a - s; parts hold PART numbers each.
        high, low = place[hot] // PART, (place[hot] - w[hot] + 1) // PART
        parts = high - low + 1
        j = np.repeat(np.arange(len(a)), parts)
        part = low[j] + np.arange(len(j)) - np.repeat(np.cumsum(parts) - parts, parts)
        most = np.minimum(part * PART + PART - 1, place[hot][j])
        least = np.maximum(part * PART, (place[hot] - w[hot] + 1)[j])
        shared = K.hashes(text, a[j] - part * PART, a[j] - (part * PART + PART - 1) + width)
        rows = ((s[cold], a[j] - most), (w[cold], most - least + 1), (key[cold], K.mix(key[hot][j] + part.astype(U)) ^ shared))
        return [np.concatenate(x) for x in rows]

    def packed(rows):
        """rows: (t, u, s, w, key, c, d, contexts, text) of some texts."""
        size = [len(r[2]) + 1 for r in rows]
        own = np.zeros(sum(size), bool)
        own[np.cumsum(size) - 1] = True

        def join(i, kind, last=0):
            return np.concatenate([np.append(r[i], last) for r in rows]).astype(kind)

        arrays = [
            pa.array(join(4, U).view(np.int64), mask=own), pa.array(join(5, U).view(np.int64)), pa.array(join(6, U).view(np.int64)), pa.array(np.repeat([r[0] for r in rows], size)),
            pa.array(np.repeat([r[1] for r in rows], size)), pa.array(join(2, np.int64)), pa.array(join(3, np.int32)), pa.array([x for r in rows for x in (*r[7], r[8])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "c", "d", "t", "u", "s", "w", "ctx"])

    def run(batches):
        known_texts: set[tuple[int, int]] = set()
        sent: dict[int, int] = {}
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(2))
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            runs, at = batch.column(3), batch.column(3).offsets.to_numpy()
            fields = [runs.values.field(j).to_numpy(zero_copy_only=False) for j in range(3)]
            rows, held = [], 0
            for i, mark in enumerate(own):
                if mark in known_texts:
                    continue
                if len(sent) + len(known_texts) > REMEMBERED:
                    sent.clear()
                    known_texts.clear()
                known_texts.add(mark)
                text = data[offsets[i] : offsets[i + 1]]
                h, p, hot = (f[at[i] : at[i + 1]] for f in fields)
                s, w, place, key = p >> 16, (p >> 8) & 255, p & 255, h.view(U)
                if hot.any():
                    s, w, key = split_hot(text, s, w, place, key, hot)
                # A context is told by its key, which holds a hash of its anchor, and by two hashes of all its bytes.
                e = s + w + width - 1
                c, d = K.hashes(text, s, e), K.hashes(text, s, e, _OTHER_BASE)
                raw, contexts = text.tobytes(), []
                for b, other, x, y in zip(K.mix(key ^ (c * U(3))).tolist(), d.tolist(), s.tolist(), e.tolist()):
                    n = sent.get(b, 0)
                    if n >> 2 != other:
                        n = other << 2
                    if n & 3 < 2:
                        sent[b] = n + 1
                        contexts.append(raw[x:y])
                    else:
                        contexts.append(None)
                rows.append((*mark, s, w, key, c, d, contexts, raw))
                held += len(raw) * 4
                if held > 8 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return found.mapInArrow(run, _CONTEXT)


def _sort_shard(contexts: list[bytes], windows: list[int], width: int) -> list[np.ndarray]:
    """For each context, which of its windows start a string that also starts elsewhere in the shard."""
    size = np.array([len(x) for x in contexts])
    start = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = raw.astype(np.int16) + 1
    text[start + size] = 0
    order = suffix_order(text, QUEUE_BYTES)
    del text
    ends = np.zeros(len(raw) + 1, np.int8)
    ends[start] += 1
    ends[start + np.clip(np.minimum(windows, size - width + 1), 0, None)] -= 1
    is_window = np.cumsum(ends[:-1], dtype=np.int8) > 0
    order = order[is_window[order]]
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
    same = np.ones(max(len(order) - 1, 0), bool)
    for lo in range(0, len(same), COMPARED):
        live = np.arange(lo, min(lo + COMPARED, len(same)))
        for at in [*range(0, width - 7, 8), width - 8]:  # neighbours' common prefix, tested up to `width`
            eq = words[order[live] + at] == words[order[live + 1] + at]
            same[live[~eq]] = False
            live = live[eq]
    hit = np.zeros(len(raw), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[a : a + w] for a, w in zip(start.tolist(), windows)]


_RANGES = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def _repeats(contexts: DataFrame, width: int) -> DataFrame:
    """(key, c, d, ranges): windows [a, b) of each distinct context that repeat. contexts are sorted by key in partitions."""
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in "kcd"], T.StructField("ranges", _RANGES)])

    def run(batches):
        group: dict[tuple[int, int], list] = {}
        key = None
        shard: list[tuple[int, int, int, bytes, int, bool]] = []
        held = 0

        def close():
            nonlocal held
            if len(group) == 1:
                ((c, d), (ctx, w, _, multi)), = group.items()
                if multi:
                    yield key, c, d, [(0, w)]
            elif group:
                for (c, d), (ctx, w, _, multi) in group.items():
                    shard.append((key, c, d, ctx, w, multi))
                    held += len(ctx)
                if held >= SHARD_BYTES:
                    yield from flush()
            group.clear()

        def flush():
            nonlocal held
            if shard:
                for (k, c, d, _, w, multi), hit in zip(shard, _sort_shard([x[3] for x in shard], [x[4] for x in shard], width)):
                    if multi:
                        yield k, c, d, [(0, w)]
                    elif hit.any():
                        e = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                        yield k, c, d, list(zip(e[::2].tolist(), e[1::2].tolist()))
            shard.clear()
            held = 0

        def batch_of(rows):
            n = [len(r[3]) for r in rows]
            flat = [x for r in rows for x in r[3]]
            values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], ["a", "b"])
            return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], lists(values, np.array(n))], names=["k", "c", "d", "ranges"])

        for batch in trimmed(batches):
            out = []
            for k, c, d, t, u, s, w, ctx in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if k != key:
                    out += close()
                    key = k
                was = group.get((c, d))
                if was is None:
                    group[c, d] = (ctx, w, (t, u, s), False)
                elif not was[3] and was[2] != (t, u, s):
                    group[c, d] = (*was[:3], True)
            if out:
                yield batch_of(out)
        out = [*close(), *flush()]
        if out:
            yield batch_of(out)

    return contexts.mapInArrow(run, schema)


def _removed(texts: DataFrame, width: int, carry: bool) -> DataFrame:
    """Per text (t, u, text, runs): n_removed, n_spans, kept_sha256 and, if asked, what is left with whole characters only."""
    names = ["t", "u", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * carry

    def run(batches):
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(2))
            out = []
            for i, (t, u, runs) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)))):
                text = data[offsets[i] : offsets[i + 1]]
                mark = np.zeros(len(text) + 1, np.int64)
                for r in runs:
                    mark[r["a"]] += 1
                    mark[r["b"]] -= 1
                gone = np.cumsum(mark[:-1]) > 0
                kept = text[~gone].tobytes()
                spans = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) > 0).sum())
                row = [t, u, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()]
                if carry:
                    # A character that is removed in part stays whole.
                    lead = np.flatnonzero((text & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, lead)
                    row.append(text[~np.repeat(whole, np.diff(np.append(lead, len(text))))].tobytes().decode("utf-8", "replace"))
                out.append(row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), types)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in types[: len(names)]], names=names)

    return texts.mapInArrow(run, "t long, u long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * carry)


def _joined(rows: DataFrame, times: DataFrame) -> DataFrame:
    """rows of the anchors in times (h, times), with hot. What a very frequent anchor has is dealt over several keys."""
    total = rows.count()
    bound = max(LEAST, total // SPREAD)
    heavy = times.where(F.col("times") > bound).select("h", F.ceil(F.col("times") / bound).cast("int").alias("parts"))  # SPREAD rows at most
    own = rows.withColumn("row", F.xxhash64("_metadata.file_name", "_metadata.row_index")).join(F.broadcast(heavy), "h", "left")
    own = own.withColumn("part", F.coalesce(F.pmod("row", "parts"), F.lit(0)).cast("int")).drop("row", "parts")
    parts = F.when(F.col("times") > bound, F.ceil(F.col("times") / bound).cast("int")).otherwise(F.lit(1))
    other = times.select("h", (F.col("times") >= HOT).alias("hot"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return own.join(other, ["h", "part"]).drop("part")


def repeated_spans(docs: DataFrame, text: str = "text", width: int = 200, kept: str | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256; `kept` names a column for the text that is left.

    Texts are taken as UTF-8 bytes, null as empty; strings never cross documents; of two equal texts of `width` bytes or
    more nothing is left, and shorter texts stay whole. Texts, and the contexts of an anchor, are told apart by 128 bits of
    hashes. Texts of any length are cut into runs and may lie in any number of shards. Repeated rows are copies of each other;
    an empty table gives no rows. Columns of docs with the names of added ones are replaced. `width` is from 128 to 255 + GRAM.
    """
    added = {"n_bytes", "n_removed", "n_spans", "kept_sha256", kept}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added or c == text], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    marked = base.withColumn("__t", F.xxhash64("__text")).withColumn("__u", F.xxhash64(F.lit(7), "__text")).withColumn("__n", F.octet_length("__text"))
    long = marked.where(F.col("__n") >= width).select(F.col("__t").alias("t"), F.col("__u").alias("u"), F.col("__text").alias("text"))
    # Each step's tables go before the next one's come.
    first, second = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = first.cut(_anchor_rows(long, width))
    mark = F.xxhash64("t", "u", "p")
    times = first.cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select("h", "times"))
    runs = second.cut(_joined(rows, times).groupBy("t", "u").agg(F.collect_set(F.struct("h", "p", "hot")).alias("runs")))
    first.release()
    contexts = cut(_context_rows(long.join(runs, ["t", "u"]).select("t", "u", "text", "runs"), width))
    second.release()
    sent = contexts.where("key is not null and ctx is not null").repartition("key").sortWithinPartitions("key", "c")
    repeats = _repeats(sent, width).withColumnRenamed("k", "key")
    places = contexts.where("key is not null").select("key", "c", "d", "t", "u", "s")
    spans = places.join(repeats, ["key", "c", "d"]).select("t", "u", F.explode(F.transform("ranges", lambda r: F.struct((F.col("s") + r["a"]).alias("a"), (F.col("s") + r["b"] - 1 + width).alias("b")))).alias("r"))
    spans = spans.groupBy("t", "u").agg(F.collect_set("r").alias("runs"))
    own = contexts.where("key is null").select("t", "u", F.col("ctx").cast("string").alias("text"))
    cleaned = _removed(own.join(spans, ["t", "u"]).select("t", "u", "text", "runs"), width, kept is not None).dropDuplicates(["t", "u"])
    copies = long.groupBy("t", "u").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("t", "u", F.lit(True).alias("copied"))
    verdict = cut(cleaned.join(copies, ["t", "u"], "full_outer"))
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in added or (c == text and kept != text)]
    small = marked.withColumn("__sha", F.sha2(F.col("__text").cast("binary"), 256))
    if kept is None:
        small = small.drop("__text")
    out = small.join(verdict, (F.col("__t") == F.col("t")) & (F.col("__u") == F.col("u")), "left")
    copied = F.coalesce("copied", F.lit(False))
    result = [
        F.col("__n").cast("long").alias("n_bytes"),
        F.when(copied, F.col("__n").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "__sha")).alias("kept_sha256"),
    ]
    if kept:
        result.append(F.when(copied, F.lit("")).otherwise(F.coalesce("kept", "__text")).alias(kept))
    return out.select(*cols, *result)
