"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every document."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import cut, lists, map_text

#: Windows that one broadcast set holds. A larger benchmark is scanned set by set, each stored before the next is sent.
MAX_WINDOWS = 200_000
_BITS = 22
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", _SPAN),
]


def _words(data: np.ndarray, offsets: np.ndarray):
    low = K.LOWER[data]
    s, e, row = K.spans(K.ALNUM[low], offsets)
    return low, s, e, row, K.hashes(low, s, e)


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """(item_id, n, hash, words) of each distinct window. An item of fewer than n words, but not none, is one window."""

    def make():
        def apply(data, offsets):
            low, s, e, row, h = _words(data, offsets)
            out, counts = [], np.zeros(len(offsets) - 1, np.int64)
            first = np.searchsorted(row, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                a, b = first[i], first[i + 1]
                k = min(n, b - a)
                if k:
                    words = [low[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(s[a:b], e[a:b])]
                    found = {}
                    for j, w in enumerate(K.windows(h[a:b], int(k)).view(np.int64)):
                        found.setdefault(" ".join(words[j : j + k]), int(w))
                    out += [(int(k), w, t) for t, w in found.items()]
                    counts[i] = len(found)
            kinds = pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("words", pa.string())])
            values = pa.array([{"n": a, "hash": b, "words": c} for a, b, c in out], kinds)
            return [lists(values, counts)]

        return apply

    kind = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.StringType())]))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("t"))
    return map_text(items, "t", make, [T.StructField("w", kind)]).select("item_id", F.inline("w")).distinct()


def _scanner(table, carry: bool):
    """table: {n: (sorted hashes, {hash: [(item, words)]})}."""

    def make():
        known = {}
        for n, (keys, by) in table.value.items():
            maybe = np.zeros(1 << _BITS, bool)
            maybe[keys >> K.U(64 - _BITS)] = True
            known[n] = (keys, by, maybe)

        def apply(data, offsets):
            low, s, e, row, h = _words(data, offsets)
            rows, items = len(offsets) - 1, defaultdict(set)
            mark = np.zeros(len(s) + 1, np.int64)
            for n, (keys, by, maybe) in known.items():
                w = K.windows(h, n)
                at = np.flatnonzero(maybe[w >> K.U(64 - _BITS)])
                at = at[row[at] == row[at + n - 1]]
                at = at[keys[np.minimum(np.searchsorted(keys, w[at]), len(keys) - 1)] == w[at]]
                for i in at.tolist():
                    words = b" ".join(low[a:b].tobytes() for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist())).decode("utf-8", "replace")
                    hit = [item for item, text in by[int(w[i])] if text == words]
                    if hit:
                        items[int(row[i])].update(hit)
                        mark[i] += 1
                        mark[i + n] -= 1
            hit = np.cumsum(mark[:-1]) > 0
            n_words = K.per_row(row, rows)
            # A removable span runs from the first byte of a hit run of words to the last; spans never cross a document.
            change = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
            a, b = change[::2], change[1::2]
            cross = [np.arange(x, y)[np.flatnonzero(np.diff(row[x:y]))] + 1 for x, y in zip(a, b) if row[x] != row[y - 1]]
            extra = np.concatenate(cross) if cross else np.zeros(0, np.int64)
            a, b = np.sort(np.concatenate((a, extra))), np.sort(np.concatenate((b, extra)))
            owner = row[a] if len(a) else np.zeros(0, np.int64)
            at0 = offsets[owner]
            span = pa.StructArray.from_arrays([pa.array(s[a] - at0), pa.array(e[b - 1] - at0)], ["start", "end"])
            found = [sorted(x for x in items.get(i, ()) if x is not None) for i in range(rows)]
            out = [
                pa.array(n_words.astype(np.int64)),
                pa.array(np.bincount(row[hit], minlength=rows).astype(np.int64)),
                pa.array(found, pa.list_(pa.string())),
                lists(span, np.bincount(owner, minlength=rows)),
            ]
            if carry:
                out.append(_without(data, offsets, s[a], e[b - 1], owner))
            return out

        return apply

    return make


def _without(data, offsets, a, b, owner) -> pa.Array:
    """The texts without the bytes of the spans; a span's own following blanks go with it when both sides are blank."""
    keep = np.ones(len(data), bool)
    for x, y in zip(a.tolist(), b.tolist()):
        keep[x:y] = False
    sizes = np.add.reduceat(np.concatenate((keep, [False])).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if len(offsets) > 1 else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    out = data[keep].tobytes()
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(out)).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, clean: str | None = None) -> DataFrame:
    """docs with n_words, n_hit, items (ids whose windows occur, sorted as strings) and spans (byte ranges of hit words).

    clean names a column for the text without the spans; to drop documents, filter on n_hit. A hash match is verified on
    the words themselves. Null or empty texts have no words, items without words have no window, and items with a null
    id count as hits but are not listed. Repeated rows are judged row by row; columns of docs that have the names of added
    ones are replaced; texts of any length are scanned whole; an empty table on either side gives no rows or no hits. A
    benchmark of more than MAX_WINDOWS windows is scanned in several sets, united per document.
    """
    spark = docs.sparkSession
    found = benchmark_windows(benchmark, item_id, item_text, n)
    total = found.count()
    passes = max(1, -(-total // MAX_WINDOWS))
    if passes > 1:
        return _in_passes(docs, found, passes, text, clean)
    return _scan(docs, found, spark, text, clean)


def _table(found: DataFrame):
    by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r in found.toLocalIterator():
        by[r["n"]][r["hash"] % (1 << 64)].append((r["item_id"], r["words"]))
    return {n: (np.sort(np.array(list(x), np.uint64)), dict(x)) for n, x in by.items()}


def _scan(docs, found, spark, text, clean):
    fields = FIELDS + ([T.StructField(clean, T.StringType())] if clean else [])
    return map_text(docs, text, _scanner(spark.sparkContext.broadcast(_table(found)), clean is not None), fields)


def _in_passes(docs, found, passes, text, clean):
    """One scan per set of windows, of which one is out at a time; what a row's sets find is united at the end. Rows are told
    apart by their place in a stored copy."""
    spark = docs.sparkSession
    stored, found = cut(docs), cut(found)
    rows = stored.select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("__row"))
    hits = None
    for i in range(passes):
        shared = spark.sparkContext.broadcast(_table(found.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == i)))
        scanned = map_text(rows.select("__row", F.col(f"`{text}`").alias("__t")), "__t", _scanner(shared, False), FIELDS)
        own = cut(scanned.where("n_hit > 0").select("__row", "items", "spans"))
        shared.destroy()
        hits = own if hits is None else hits.unionByName(own)
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    per = hits.groupBy("__row").agg(items.alias("items"), F.flatten(F.collect_list("spans")).alias("__all"))  # at most `passes` rows each
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    out = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__t"), "__row").join(per, "__row", "left")
    out = out.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("items", F.array().cast("array<string>")).alias("items"), "__all", "__t")

    schema = T.StructType([docs.schema[c] for c in kept if c != clean] + FIELDS + ([T.StructField(clean, T.StringType())] if clean else []))

    def unite(batches):
        for batch in batches:
            cols = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            texts, rows = cols["__t"].to_pylist(), []
            for t, ranges in zip(texts, cols["__all"].to_pylist()):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                _, s, e, _, _ = _words(raw, np.array([0, len(raw)]))
                mark = np.zeros(len(raw) + 1, np.int64)
                for x in ranges or []:
                    mark[x["start"]] += 1
                    mark[x["end"]] -= 1
                covered = np.cumsum(mark)[:-1] > 0
                hit = covered[s] if len(s) else np.zeros(0, bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                span = [(int(s[a]), int(e[b - 1])) for a, b in zip(edge[::2], edge[1::2])]
                keep = np.ones(len(raw), bool)
                for a, b in span:
                    keep[a:b] = False
                rows.append((len(s), int(hit.sum()), span, raw[keep].tobytes().decode("utf-8", "replace")))
            arrays = [cols[c] for c in kept if c != clean]
            arrays += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), cols["items"]]
            arrays.append(pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            if clean:
                arrays.append(pa.array([r[3] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return out.mapInArrow(unite, schema)
