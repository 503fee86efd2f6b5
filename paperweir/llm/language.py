"""Language identification: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import held_out, map_text, text_bytes

#: Hashed features, documents of each language to fit on, words of a training sequence, words of a language in the lexicon.
BITS, MOST, WORDS, LEXICON = 17, 400, 64, 4000
#: Bytes of labelled text that a fit takes to the driver at most: documents come whole, by their turn in their language.
FIT_BYTES = 32 << 20
#: Weights (codes times languages) of a model are 2**WEIGHTS at most: with more than 64 languages, codes share weights sooner.
WEIGHTS = 23
#: Share of training sequences into which a run of another document's words is spliced.
SWITCHED = 0.3

_FOLD = K.LOWER.copy()
#: Lower case of the characters of two bytes, where that has two bytes as well.
_SMALL = np.arange(0x800)
for _c in range(0x80, 0x800):
    if len(_l := chr(_c).lower()) == 1 and 0x80 <= ord(_l) < 0x800:
        _SMALL[_c] = ord(_l)
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = _INSIDE[128:] = True


def words(data: np.ndarray, offsets: np.ndarray):
    """Folded bytes, and start, end and row of each word: letters and all non-ASCII characters. Capitals are folded where the
    small letter has as many bytes, up to two."""
    low = _FOLD[data]
    two = np.flatnonzero((low >= 0xC2) & (low < 0xE0))
    if len(two):
        small = _SMALL[(low[two].astype(np.int64) & 31) << 6 | low[two + 1] & 63]
        low[two], low[two + 1] = 0xC0 | small >> 6, 0x80 | small & 63
    s, e, row = K.spans(_INSIDE[low], offsets)
    return low, s, e, row


def segments(row: np.ndarray, rows: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each row's chain, or of its parts of `most` words; every word lies in one."""
    n = np.bincount(row, minlength=rows)
    parts = -(-n // most) if most else (n > 0).astype(np.int64)
    first = np.cumsum(n) - n
    i = np.repeat(np.arange(rows), parts)
    k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
    return (first[i] + most * k, np.minimum(most, n[i] - most * k)) if most else (first[i], n[i])


def switched(label: np.ndarray, first: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Training sequences as word numbers: each segment, and into SWITCHED of them a run of 1 to 16 words of a segment of
    another label is spliced at a random place, so that changes of label inside a text are learned from texts that have them."""
    out = []
    for f, n in zip(first.tolist(), size.tolist()):
        own = np.arange(f, f + n)
        if rng.random() < SWITCHED:
            j = int(rng.integers(0, len(first)))
            if label[first[j]] != label[f]:
                run = int(rng.integers(1, min(16, size[j]) + 1))
                start = int(first[j] + rng.integers(0, size[j] - run + 1))
                at = int(rng.integers(0, n + 1))
                own = np.concatenate((own[:at], np.arange(start, start + run), own[at:]))
        out.append(own)
    return out


def features(low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray] | None, bits: int = BITS):
    """Hashed features of each word: itself, prefixes and suffixes of 1 to 4 bytes, all trigrams with word ends, lexicon entry."""
    n = e - s
    codes, owners = [h], [np.arange(len(s))]
    for k in range(1, 5):
        i = np.flatnonzero(n >= k)
        for kind, a in ((1, s[i]), (2, e[i] - k)):
            code = np.zeros(len(i), K.U)
            for j in range(k):
                code = code * K.U(257) + low[a + j].astype(K.U) + K.U(1)
            codes.append(K.mix(code * K.U(16) + K.U(kind * 5 + k)))
            owners.append(i)
    padded = np.concatenate((low, np.zeros(2, np.uint8)))
    i = np.repeat(np.arange(len(s)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
    left = e[i] - at
    b1 = np.where(left > 1, padded[at + 1], 0).astype(K.U)
    b2 = np.where(left > 2, padded[at + 2], 0).astype(K.U)
    codes.append(K.mix((padded[at].astype(K.U) << K.U(16)) + (b1 << K.U(8)) + b2 + K.U(0xABC000000)))
    owners.append(i)
    if lexicon is not None and len(lexicon[0]):
        at = np.minimum(np.searchsorted(lexicon[0], h), len(lexicon[0]) - 1)
        i = np.flatnonzero(lexicon[0][at] == h)
        codes.append(K.mix(lexicon[1][at[i]].astype(K.U) + K.U(0xDEF000000)))
        owners.append(i)
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(s))
    return (code[order] >> K.U(64 - bits)).astype(np.int64), count


def emissions(weights: np.ndarray, codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    lead = np.cumsum(count) - count
    return np.stack([np.add.reduceat(weights[codes, j], lead) for j in range(weights.shape[1])], 1)


def forward_backward(emission: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Marginals of each word; with pairs, also the expected transitions and starts and the log of the normaliser.

    All segments run side by side, longest first; each row of `emission` is a word."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    labels = emission.shape[1]
    peak = emission.max(1, keepdims=True)
    psi = np.exp(emission - peak)
    step, start = np.exp(move), np.exp(begin)
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max(initial=0)))]  # size > t
    alpha, gamma, log_z = np.zeros_like(psi), np.zeros_like(psi), peak.sum()
    scales = []
    for t, n in enumerate(active):
        at = first[:n] + t
        a = (start[None, :] if t == 0 else alpha[at - 1] @ step) * psi[at]
        z = a.sum(1, keepdims=True)
        alpha[at] = a / z
        scales.append(z)
        if pairs:
            log_z += np.log(z).sum()
    beta = np.ones((len(first), labels))
    expected = np.zeros((labels, labels))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        g = alpha[at] * beta[:n]
        g /= g.sum(1, keepdims=True)
        gamma[at] = g
        if t:
            onward = psi[at] * beta[:n] / scales[t]
            if pairs:
                expected += (alpha[at - 1].T @ onward) * step
            beta[:n] = onward @ step.T
    if pairs:
        return gamma, expected, gamma[first].sum(0), log_z
    return gamma


def fit_crf(low, s, e, row, label, languages: int, rows: int, rounds: int = 4, seed: int = 3) -> dict:
    """Adaptive-gradient ascent on the log-likelihood of the words' labels: those of their documents, in sequences of which
    some hold words of two documents."""
    bits = min(BITS, WEIGHTS - max(0, languages - 1).bit_length())
    h = K.hashes(low, s, e)
    keys, first_of, back = np.unique(h, return_index=True, return_inverse=True)
    of = label[row]
    share = np.bincount(back * languages + of, minlength=len(keys) * languages).reshape(-1, languages)
    top, total = share.argmax(1), share.sum(1)
    sure = np.flatnonzero((total >= 3) & (share.max(1) >= 0.8 * total))
    sure = np.concatenate([c[np.argsort(-total[c], kind="stable")][:LEXICON] for c in (sure[top[sure] == j] for j in range(languages))])
    sure = np.sort(sure)
    lexicon = (keys[sure], top[sure])
    codes, count = features(low, s[first_of], e[first_of], keys, lexicon, bits)
    lead = np.concatenate(([0], np.cumsum(count)))
    rng = np.random.default_rng(seed)
    chains = switched(of, *segments(row, rows, WORDS), rng)
    w, move, begin = np.zeros((1 << bits, languages)), np.zeros((languages, languages)), np.zeros(languages)
    gw, gm, gb = np.full(w.shape, 1e-2), np.full(move.shape, 1e-2), np.full(begin.shape, 1e-2)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 128)):
            n = np.array([len(chains[i]) for i in part])
            at = np.concatenate([chains[i] for i in part])
            uniq, inv = np.unique(back[at], return_inverse=True)
            c = count[uniq]
            flat = codes[np.repeat(lead[uniq] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            em = emissions(w, flat, c)[inv]
            own_first = np.cumsum(n) - n
            gamma, pair, start, _ = forward_backward(em, own_first, n, move, begin, True)
            truth = of[at]
            diff = -gamma
            diff[np.arange(len(at)), truth] += 1
            by_word = np.stack([np.bincount(inv, weights=diff[:, j], minlength=len(uniq)) for j in range(languages)], 1)
            where, spot = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(spot, weights=np.repeat(by_word[:, j], c), minlength=len(where)) for j in range(languages)], 1) - 1e-3 * w[where]
            gw[where] += grad**2
            w[where] += 0.3 * grad / np.sqrt(gw[where])
            seen = np.bincount(truth[own_first], minlength=languages)
            inner = np.ones(len(at), bool)
            inner[own_first] = False
            t = np.flatnonzero(inner)
            moves = np.bincount(truth[t - 1] * languages + truth[t], minlength=languages**2).reshape(languages, languages)
            for p, acc, g in ((move, gm, moves - pair), (begin, gb, seen - start)):
                g = g - 1e-3 * p
                acc += g**2
                p += 0.1 * g / np.sqrt(acc)
    return {"w": w.astype(np.float32), "bits": bits, "move": move, "begin": begin, "lexicon": lexicon}


def fit(docs: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 11, fit_bytes: int = FIT_BYTES) -> dict:
    """Learns from about `most` documents of each language that are not held out, in the order of a seeded hash of the id.

    Every language that occurs is learned. Documents come to the driver whole, the first of each language before the second
    of any, while their texts stay within `fit_bytes` together. Null texts, languages and held-out ids are left out; rows
    repeated in full count once; ties of the hash go by id and text."""
    own = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("d"))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    mark = F.xxhash64(F.lit(seed), "d")
    key = own.select("d", "lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), mark.alias("mark"))
    key = key.join(F.broadcast(counts), "lang").where(F.pmod("mark", F.lit(1_000_000)) / 1_000_000 < F.lit(1.2 * most) / F.col("n")).drop("n")  # a row per language
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "d", "h"))
    found = key.distinct().withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", "lang")
    total, chosen = 0, []
    for r in found.toLocalIterator():
        total += r["size"]
        if total > fit_bytes:
            break
        chosen.append((r["d"], r["lang"], r["h"]))
    if not chosen:
        return {"names": []}
    few = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", docs.schema[doc_id].dataType), T.StructField("l", T.StringType()), T.StructField("g", T.LongType())]))
    marked = own.withColumn("h", F.xxhash64("text"))
    # At most `most` small rows per language.
    picked = marked.join(F.broadcast(few), marked.d.eqNullSafe(few.k) & (marked.lang == few.l) & (marked.h == few.g)).select("d", "lang", "h", "text").dropDuplicates(["d", "lang", "h"])
    table = picked.toArrow().sort_by([("lang", "ascending"), ("h", "ascending"), ("d", "ascending")])
    names = sorted(set(table.column("lang").to_pylist()))
    label = np.searchsorted(np.array(names, dtype=object), np.array(table.column("lang").to_pylist(), dtype=object)).astype(np.int64)
    low, s, e, row = words(*text_bytes(table.column("text")))
    if not len(s):
        return {"names": []}
    model = fit_crf(low, s, e, row, label, len(names), table.num_rows) | {"names": names}
    K.forget()
    return model


class Tagger:
    """Marginals of every word; emissions of distinct words are remembered between calls."""

    KEEP = 500_000

    def __init__(self, model: dict):
        self.m = model
        self._clear()

    def _clear(self):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(self.m["names"])), np.float32)

    def emission(self, low, s, e):
        h = K.hashes(low, s, e)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.zeros((len(keys), len(self.m["names"])), np.float32)
        values[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            codes, count = features(low, s[first[new]], e[first[new]], keys[new], self.m["lexicon"], self.m["bits"])
            values[new] = emissions(self.m["w"], codes, count)
            if len(self.keys) + len(new) > self.KEEP:
                self._clear()
            k = np.concatenate((self.keys, keys[new]))
            order = np.argsort(k)
            self.keys, self.rows = k[order], np.concatenate((self.rows, values[new]))[order]
        return values[back]

    def tag(self, data, offsets):
        low, s, e, row = words(data, offsets)
        if not len(s):
            return np.zeros((0, len(self.m["names"]))), s, e, row
        first, size = segments(row, len(offsets) - 1)  # a document is one chain, however long
        return forward_backward(self.emission(low, s, e).astype(np.float64), first, size, self.m["move"], self.m["begin"]), s, e, row


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (K.LOWER[data] >= 97) & (K.LOWER[data] < 123)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the words' mean probability of it) and word_langs (per language found: its words' share).

    A text that is null or has no letter is `und` with score 0; so is every text if nothing could be learned. Texts of any
    length are one chain; of languages of equal probability the first by name is taken; repeated rows are judged alike; an
    empty table gives no rows; columns of docs with the names of added ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**WEIGHTS numbers at most
    kind = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))

    def make():
        tagger = Tagger(shared.value)
        names = np.array(shared.value["names"] + ["und"], dtype=object)

        def apply(data, offsets):
            rows, k = len(offsets) - 1, len(names) - 1
            best, top, shares = np.full(rows, k), np.zeros(rows), [[] for _ in range(rows)]
            if k:
                gamma, _, _, row = tagger.tag(data, offsets)
                total = np.stack([np.bincount(row, weights=gamma[:, j], minlength=rows) for j in range(k)], 1)
                n = np.bincount(row, minlength=rows)
                ok = (n > 0) & _has_letter(data, offsets)
                mean = total / np.maximum(n, 1)[:, None]
                best = np.where(ok, mean.argmax(1), k)
                top = np.where(ok, np.clip(mean.max(1), 0, 1), 0.0)
                shares = [[{"lang": names[j], "share": float(m[j])} for j in np.flatnonzero(m >= 0.01)] if o else [] for m, o in zip(mean, ok)]
            arrow = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            return [pa.array(names[best].tolist(), pa.string()), pa.array(top), pa.array(shares, arrow)]

        return apply

    # Chains run side by side, as many steps as the longest has words: large batches serve more rows per step.
    most = max(1 << 18, (4 << 20) * 4 // max(4, len(model["names"])))
    return map_text(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_langs", kind)], most)
