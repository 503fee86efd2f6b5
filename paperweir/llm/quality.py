"""Quality classifier: Naive Bayes support vectors over indicators of word and word-shape n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import lists, map_text
from paperweir.llm.svm import calibrate, fit_hinge, labelled_sample, sigmoid

#: Hashed n-grams, and labelled rows of each class to fit on.
BITS, MOST = 18, 2000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("x")
_SHAPE[65:91] = ord("X")
_SHAPE[48:58] = ord("9")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of each row, end to end, and their number per row.

    Words 1 and 2; shapes 1 to 3, where a run of characters of a kind counts as one and a word equal to the one before is
    marked as a repeat. Case and punctuation count."""
    rows = len(offsets) - 1
    seen = K.VISIBLE[data]
    s, e, row = K.spans(seen, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    h = K.hashes(data, s, e)
    kind = _SHAPE[data]
    first = np.zeros(len(data), bool)
    first[s] = True
    keep = seen.copy()
    keep[1:] &= (kind[1:] != kind[:-1]) | first[1:]
    to = np.concatenate(([0], np.cumsum(keep)))
    shape = K.hashes(kind[keep], to[s], to[e])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape[again] = K.U(0x5EED)
    codes, owners = [], []
    for base, stream, sizes in ((1, h, (1, 2)), (2, shape, (1, 2, 3))):
        for n in sizes:
            w = K.windows(stream ^ K.U(base), n)
            ok = np.flatnonzero(row[: len(w)] == row[n - 1 :])
            codes.append((w[ok] >> K.U(64 - BITS)).astype(np.int64))
            owners.append(row[ok])
    key = np.unique((np.concatenate(owners) << BITS) | np.concatenate(codes))
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Weights per code (the log-count ratio times the hinge model's weight), bias and calibration.

    What is learned from, and how repeated labels, ids and rows count, is labelled_sample's to say."""
    sample, sizes = labelled_sample(docs, labels, label, most, doc_id, text)

    def make():
        def apply(data, offsets):
            codes, n = features(data, offsets)
            return [lists(pa.array(codes.astype(np.int32)), n)]

        return apply

    table = map_text(sample, "text", make, [T.StructField("codes", T.ArrayType(T.IntegerType()))]).select("d", "h", "y", "codes").toArrow().sort_by([("d", "ascending"), ("h", "ascending")])
    y = table.column("y").to_numpy() * 2.0 - 1
    total = sizes.get(0, 0) + sizes.get(1, 0)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        prior = (sizes.get(1, 0) + 1) / (total + 2)
        return {"w": np.zeros(1 << BITS, np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log(prior / (1 - prior)))}
    codes = table.column("codes").combine_chunks()
    start = codes.offsets.to_numpy().astype(np.int64)
    index = codes.values.to_numpy().astype(np.int64)
    scale = np.repeat(1 / np.sqrt(np.maximum(np.diff(start), 1)), np.diff(start))
    weight = np.where(y > 0, sizes[1] / max((y > 0).sum(), 1), sizes[0] / max((y < 0).sum(), 1))

    def model(rows):
        inside = np.repeat(np.isin(np.arange(len(y)), rows), np.diff(start))
        label_of = np.repeat(y, np.diff(start))
        p, q = (np.bincount(index[inside & (label_of * s > 0)], minlength=1 << BITS) + 1.0 for s in (1, -1))
        r = np.log((p / p.sum()) / (q / q.sum()))
        own = np.concatenate(([0], np.cumsum(np.diff(start)[rows])))
        take = np.concatenate([np.arange(start[i], start[i + 1]) for i in rows])
        w = fit_hinge(own, index[take], r[index[take]] * scale[take], y[rows], 1 << BITS, np.full(len(rows), 1.0))
        return w[:-1] * r, w[-1]

    rng = np.random.default_rng(1)
    fold = rng.integers(0, 3, len(y))
    margin = np.zeros(len(y))
    for f in range(3):
        w, b = model(np.flatnonzero(fold != f))
        m = np.add.reduceat(np.concatenate((w[index] * scale, [0.0])), start[:-1])[: len(y)] * (np.diff(start) > 0) + b
        margin[fold == f] = m[fold == f]
    a, b = calibrate(margin, y, weight)
    w, bias = model(np.arange(len(y)))
    return {"w": w.astype(np.float32), "bias": float(bias), "a": a, "b": b}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. Null and empty texts get the score of a text without n-grams; texts of any length are
    scored whole; repeated rows and equal texts score alike; a column of docs that has the score's name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers of 4 bytes

    def make():
        m = shared.value

        def apply(data, offsets):
            codes, n = features(data, offsets)
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=m["w"][codes], minlength=len(n))
            return [pa.array(sigmoid(m["a"] * (total / np.sqrt(np.maximum(n, 1)) + m["bias"]) + m["b"]))]

        return apply

    return map_text(docs, text, make, [T.StructField(out, T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, most: int = MOST) -> DataFrame:
    """docs with score and predicted (1 from the threshold on, a tie included). Without labels of both classes every score is
    the smoothed share of label 1; an empty table of docs gives no rows. Columns named score or predicted are replaced."""
    return score(docs, fit(docs, labels, label, most)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
