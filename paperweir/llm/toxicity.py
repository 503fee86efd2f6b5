"""Toxicity: a support vector machine on subsequence string kernels, by Nyström landmarks, trained on labelled texts.

Two words' kernel is the squared normalised kernel of their gapped three-letter subsequences. Landmark words span a Nyström
map of it, in which a word is scaled to length 1, or to 0 if the landmarks hold too little of it to be a form of any. A
sentence's map is the sum of its words', a text's the sum of its sentences' over the root of its number of words, so that the
machine is linear in a sum of word kernels."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import map_text, steps, text_bytes, trim
from paperweir.llm.svm import calibrate, fit_hinge, labelled_sample, sigmoid

#: Labelled rows of each class, landmarks of each kind, decay per spanned character, and longest string compared whole.
MOST, LANDMARKS, DECAY, LONGEST = 1500, 32, 0.6, 16
#: Log-likelihood ratio of a candidate's own documents, and the most candidates.
LEAST_RATIO, CANDIDATES = 10.0, 192
#: Kernel value from which two words count as forms of one; share of a word's length that its map must hold.
ALIKE, HELD = 0.6, 0.2
#: Subsequences of words that are compared with the landmarks at a time.
PLACES = 1 << 19
#: Letters of the shortest beginning that words may share to be forms of one.
STEM = 5
#: What texts' maps are multiplied by before fitting, so that a word in fifty has length 1.
SCALE = 50**0.5

# Letters 1 to 26; look-alike digits and signs count as their letter; bytes of other characters share 27 to 31.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
for _sign, _is in zip("013457@$", "oieastas"):
    _LETTER[ord(_sign)] = ord(_is) - 96
_LETTER[128:] = 27 + np.arange(128) % 5
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def split(data: np.ndarray, offsets: np.ndarray):
    """Letters, start and end of each word among them, and each word's sentence, and each sentence's row.

    A word is what stands between blanks, less all that is no letter; words of one letter in a row are one word, and words
    beyond LONGEST are cut into overlapping ones. Sentences end at . ! ? and line ends that blanks or the text's end follow."""
    s, e, row = K.spans(K.VISIBLE[data], offsets)
    z = np.zeros(0, np.int64)
    if not len(s):
        return np.zeros(0, np.uint8), z, z, z, z
    letters = _LETTER[data]
    keep = letters > 0
    to = np.concatenate(([0], np.cumsum(keep)))
    flat = letters[keep]
    a, b = to[s], to[e]
    line = np.concatenate(([0], np.cumsum(data == 10)))
    stop = _STOP[data[e - 1]] & (e - s > 1)
    stop[:-1] |= (row[1:] != row[:-1]) | (line[s[1:]] != line[e[:-1]])
    sentence = np.concatenate(([0], np.cumsum(stop[:-1])))
    owner = row[np.flatnonzero(np.concatenate(([True], np.diff(sentence) > 0)))]
    has = b > a
    a, b, sentence = a[has], b[has], sentence[has]
    if not len(a):
        return flat, z, z, z, owner
    single = b - a == 1
    glue = np.zeros(len(a), bool)
    glue[1:] = single[1:] & single[:-1] & (sentence[1:] == sentence[:-1])
    head = np.flatnonzero(~glue)
    a, b, sentence = a[head], b[np.concatenate((head[1:] - 1, [len(b) - 1]))], sentence[head]
    n = b - a
    long = n > LONGEST
    if long.any():
        half = LONGEST // 2
        parts = np.where(long, -(-(n - half) // half), 1)
        i = np.repeat(np.arange(len(a)), parts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = a[i] + half * k
        a, b, sentence = starts, np.minimum(np.where(long[i], starts + LONGEST, b[i]), b[i]), sentence[i]
    return flat, a, b, sentence, owner


_combos: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all three-letter subsequences of a string of n letters, and their decay by span."""
    if n not in _combos:
        c = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _combos[n] = c, (DECAY ** (c[:, 2] - c[:, 0] + 1)).astype(np.float32)
    return _combos[n]


def _spectrum(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of words (a row each, of equal length), and weights; equal codes of a row are summed into one."""
    c, w = _triples(words.shape[1])
    code = (words[:, c[:, 0]].astype(np.int32) << 10) | (words[:, c[:, 1]].astype(np.int32) << 5) | words[:, c[:, 2]]
    return code, w


class Kernel:
    """Kernel values of words against the landmarks, and the maps of words and texts."""

    KEEP = 150_000

    def __init__(self, landmarks: list[np.ndarray]):
        self.m = len(landmarks)
        self.table = np.zeros((1 << 15, self.m), np.float32)
        for j, z in enumerate(landmarks):
            code, w = _spectrum(z[None, :])
            np.add.at(self.table[:, j], code[0], w)
        self.table /= np.maximum(np.sqrt((self.table**2).sum(0)), 1e-9)
        value, vector = np.linalg.eigh(self.of(*_joined(landmarks)).astype(float))
        self.root = (vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)
        self.rows = np.empty((self.KEEP, self.m), np.float32)  # memory is taken as rows come
        self._clear()

    def _clear(self):
        self.keys, self.slot, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0

    def of(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), self.m), np.float32)
        size = b - a
        for n in np.unique(size):
            if n < 3:
                continue
            for rows in np.array_split(np.flatnonzero(size == n), max(1, (size == n).sum() * len(_triples(int(n))[1]) // PLACES)):
                words = flat[a[rows][:, None] + np.arange(n)]
                code, w = _spectrum(words)
                acc = np.zeros((len(rows), self.m), np.float32)
                for k in range(code.shape[1]):
                    acc += w[k] * self.table[code[:, k]]
                order = np.argsort(code, axis=1)
                sorted_code = np.take_along_axis(code, order, 1)
                sorted_w = w[order]
                first = np.ones(code.shape, bool)
                first[:, 1:] = sorted_code[:, 1:] != sorted_code[:, :-1]
                sums = np.add.reduceat(sorted_w.ravel(), np.flatnonzero(first.ravel()))
                owner = np.repeat(np.arange(len(rows)), first.sum(1))
                norm = np.sqrt(np.bincount(owner, weights=sums**2, minlength=len(rows)))
                out[rows] = (acc / np.maximum(norm, 1e-9)[:, None]) ** 2  # a kernel too; likeness by chance weighs less
        return out

    def mapped(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each word's place in the landmarks' space: of length 1, or 0."""
        x = self.of(flat, a, b) @ self.root
        size = np.sqrt((x**2).sum(1))
        return x * np.where(size**2 >= HELD, 1 / np.maximum(size, 1e-9), 0).astype(np.float32)[:, None]

    def words(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maps of the distinct words, which of them each word is); maps are remembered between calls."""
        h = K.hashes(flat, a, b)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        known = np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        values = np.zeros((len(keys), self.m), np.float32)
        values[known] = self.rows[self.slot[at[known]]]
        new = np.flatnonzero(~known)
        if len(new):
            values[new] = self.mapped(flat, a[first[new]], b[first[new]])
            if self.held + len(new) > self.KEEP:
                self._clear()
                new = new[: self.KEEP]
            # Rows stay where they are put; only keys and places are sorted anew.
            end = self.held + len(new)
            self.rows[self.held : end] = values[new]
            k = np.concatenate((self.keys, keys[new]))
            order = np.argsort(k)
            self.keys, self.slot = k[order], np.concatenate((self.slot, np.arange(self.held, end, dtype=np.int32)))[order]
            self.held = end
        return values, back

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's map: the sum of its words' over the root of their number."""
        flat, a, b, sentence, owner = split(data, offsets)
        out = np.zeros((len(offsets) - 1, self.m))
        if len(a):
            values, back = self.words(flat, a, b)
            row = owner[sentence]
            held = np.flatnonzero(values.any(1)[back])
            np.add.at(out, row[held], values[back[held]])
            out /= np.sqrt(np.maximum(np.bincount(row, minlength=len(out)), 1))[:, None]
        return out


def _distinct(table: pa.Table) -> pa.Table:
    """Rows of which at most half the lines and sentences were seen in earlier rows: copies would count a text's chance words
    again and again."""
    seen: set[int] = set()
    keep = []
    for text in table.column("text").to_pylist():
        own = {hash(p) for p in text.replace("\n", ". ").split(". ") if len(p) > 20}
        keep.append(len(own & seen) * 2 <= len(own))
        seen |= own
    return table.filter(pa.array(keep, pa.bool_()))


def _ratio(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of documents by class: it needs frequency and contrast, so that chance finds stay low."""
    share = (toxic + other) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.nan_to_num(toxic * np.log(toxic / (n1 * share))) + np.nan_to_num(other * np.log(other / (n0 * share))))
        g += 2 * (np.nan_to_num((n1 - toxic) * np.log((n1 - toxic) / (n1 * (1 - share)))) + np.nan_to_num((n0 - other) * np.log((n0 - other) / (n0 * (1 - share)))))
    return np.where(toxic * n0 > other * n1, g, 0.0)


def _joined(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of words end to end, and where each starts and ends."""
    ends = np.cumsum([len(z) for z in words])
    return np.concatenate(words), ends - [len(z) for z in words], ends


def _stems(flat, a, b, pair, bad_row, most: int) -> list[np.ndarray]:
    """The best of the beginnings, STEM letters and a few more, that toxic rows hold more often than chance: an insult whose
    every form is rare has a frequent stem."""
    n1, n0 = max(bad_row.sum(), 1), max((~bad_row).sum(), 1)
    found = []
    for n in range(STEM, STEM + 4):
        long = np.flatnonzero((b - a > n) & (b - a <= LONGEST))
        if not len(long):
            continue
        _, lead, at = np.unique(K.hashes(flat, a[long], a[long] + n), return_index=True, return_inverse=True)
        of = np.full(len(a), -1)
        of[long] = at
        own = np.stack((pair[:, 0], of[pair[:, 1]]), 1)
        own = np.unique(own[own[:, 1] >= 0], axis=0)
        toxic = np.bincount(own[:, 1], weights=bad_row[own[:, 0]], minlength=len(lead))
        g = _ratio(toxic, np.bincount(own[:, 1], minlength=len(lead)) - toxic, n1, n0)
        best = np.argsort(-g, kind="stable")[:most]
        found += [(-g[i], n, flat[a[long[lead[i]]] : a[long[lead[i]]] + n]) for i in best if g[i] >= LEAST_RATIO]
    return [z for _, _, z in sorted(found, key=lambda f: f[:2])[:most]]


def _like(landmarks: list[np.ndarray], flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each word is a form of each landmark."""
    kernel = Kernel(landmarks)
    return np.concatenate([kernel.of(flat, a[lo : lo + 20_000], b[lo : lo + 20_000]) >= ALIKE for lo in range(0, len(a), 20_000)])


def _vocabulary(data: np.ndarray, offsets: np.ndarray):
    """Letters of the distinct words end to end, start and end of each, and the distinct (row, word) pairs. Texts are split a
    step at a time, so that only their words are held."""
    known, letters, size, rows, marks = np.zeros(0, np.uint64), [], [], [], []
    for lo, hi in steps(offsets):
        flat, a, b, sentence, owner = split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(a):
            continue
        keys, first, back = np.unique(K.hashes(flat, a, b), return_index=True, return_inverse=True)
        pair = np.unique(owner[sentence].astype(np.int64) * len(keys) + back)
        rows.append(pair // len(keys) + lo)
        marks.append(keys[pair % len(keys)])
        new = np.flatnonzero(~np.isin(keys, known))
        known = np.concatenate((known, keys[new]))
        size.append((b - a)[first[new]])
        letters += [flat[x:y] for x, y in zip(a[first[new]].tolist(), b[first[new]].tolist())]
    K.forget()
    if not len(known):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, np.zeros((0, 2), np.int64)
    order = np.argsort(known)
    size = np.concatenate(size)[order]
    flat = np.concatenate([letters[i] for i in order.tolist()])
    ends = np.cumsum(size)
    return flat, ends - size, ends, np.stack((np.concatenate(rows), np.searchsorted(known[order], np.concatenate(marks))), 1)


def _landmarks(data, offsets, y, each):
    """Words that toxic rows hold more often than chance.

    A word is measured with all its forms, words of like kernel, so that an inflected insult counts whole; words like one that
    is taken are skipped. The bar is what chance reaches among so many words, not a share of the best: a language with few
    labelled rows need not keep up with one that has many."""
    flat, a, b, pair = _vocabulary(data, offsets)
    words = len(a)
    bad_row = y > 0
    toxic = np.bincount(pair[:, 1], weights=bad_row[pair[:, 0]], minlength=words)
    other = np.bincount(pair[:, 1], weights=~bad_row[pair[:, 0]], minlength=words)
    n1, n0 = max(bad_row.sum(), 1), max((~bad_row).sum(), 1)
    g = _ratio(toxic, other, n1, n0)
    size = b - a
    fit = (size >= 3) & (size <= LONGEST)
    word = lambda i: flat[a[i] : b[i]]
    best = [i for i in np.argsort(-g, kind="stable") if fit[i] and g[i] >= LEAST_RATIO][:CANDIDATES]
    found = [word(i) for i in best]
    known = {z.tobytes() for z in found}
    found += [z for z in _stems(flat, a, b, pair, bad_row, CANDIDATES // 2) if z.tobytes() not in known]
    bad: list[int] = []
    if found:
        like = _like(found, flat, a, b)
        among = _like(found, *_joined(found))
        rows = np.zeros((len(y), len(found)), bool)
        for j in range(len(found)):
            rows[pair[like[pair[:, 1], j], 0], j] = True
        least = max(LEAST_RATIO, 2 * float(np.log(words)))
        spent, left = np.zeros(len(found), bool), np.ones(len(y), bool)
        for _ in range(2):  # over all rows, then over those that what is taken leaves unexplained
            while len(bad) < each:
                one, none = rows[bad_row & left], rows[~bad_row & left]
                pooled = np.where(spent, 0.0, _ratio(one.sum(0), none.sum(0), max(len(one), 1), max(len(none), 1)))
                j = int(np.argmax(pooled))
                if pooled[j] < least:
                    break
                spent |= among[:, j]
                spent[j] = True
                bad.append(j)
            forms = like[:, bad].any(1)
            left = np.bincount(pair[forms[pair[:, 1]], 0], minlength=len(y)) < 2  # a single form may stand by chance
    return [found[j] for j in bad]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST, doc_id: str = "doc_id", text: str = "text", each: int = LANDMARKS) -> dict:
    """Landmarks, their weights, bias and calibration.

    What is learned from, and how repeated labels, ids and rows count, is labelled_sample's to say."""
    sample, sizes = labelled_sample(docs, labels, label, most, doc_id, text)
    model = learn(sample.select("d", "h", "text", "y").toArrow().sort_by([("d", "ascending"), ("h", "ascending")]), sizes, each)
    trim()
    return model


def learn(table: pa.Table, sizes: dict[int, int], each: int = LANDMARKS) -> dict:
    """fit() on rows (text, y) and the classes' sizes."""
    table = _distinct(table)
    y = table.column("y").to_numpy() * 2.0 - 1
    total = sizes.get(0, 0) + sizes.get(1, 0)
    prior = (sizes.get(1, 0) + 1) / (total + 2)
    blank = {"landmarks": [np.array([1, 2, 3], np.uint8)], "w": np.zeros(1), "bias": 0.0, "a": 0.0, "b": float(np.log(prior / (1 - prior)))}
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return blank
    data, offsets = text_bytes(table.column("text"))
    landmarks = _landmarks(data, offsets, y, each)
    if not landmarks:
        return blank
    kernel = Kernel(landmarks)
    x = np.concatenate([kernel.texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in steps(offsets)]) * SCALE
    K.forget()
    m = x.shape[1]

    def model(rows):
        return fit_hinge(np.arange(len(rows) + 1) * m, np.tile(np.arange(m), len(rows)), x[rows].ravel(), y[rows], m, np.ones(len(rows)), rounds=30)

    fold, margin = np.random.default_rng(1).integers(0, 3, len(y)), np.zeros(len(y))
    for f in range(3):
        w = model(np.flatnonzero(fold != f))
        margin[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    a, b = calibrate(margin, y, np.where(y > 0, sizes[1] / (y > 0).sum(), sizes[0] / (y < 0).sum()))
    w = model(np.arange(len(y)))
    return {"landmarks": landmarks, "w": w[:-1] * SCALE, "bias": float(w[-1]), "a": a, "b": b}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. Null, empty and letterless texts get that of a text without words; texts of any length
    are scored whole; repeated rows and equal texts score alike; a column of docs that has the score's name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen short strings and numbers

    def make():
        m = shared.value
        kernel = Kernel(m["landmarks"])

        def apply(data, offsets):
            return [pa.array(sigmoid(m["a"] * (kernel.texts(data, offsets) @ m["w"] + m["bias"]) + m["b"]))]

        return apply

    return map_text(docs, text, make, [T.StructField(out, T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, most: int = MOST) -> DataFrame:
    """docs with score and predicted (1 from the threshold on, a tie included). Without labels of both classes, or without
    telling words, every score is the smoothed share of label 1; an empty table of docs gives no rows. Columns named score or
    predicted are replaced."""
    return score(docs, fit(docs, labels, label, most)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
