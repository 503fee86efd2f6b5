"""Byte-level BPE ids of many texts at once: each distinct pre-token is encoded once and its ids are gathered."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from paperweir.llm import tokens as K

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_kinds: np.ndarray | None = None
#: White space of the pre-token pattern besides the categories below.
_BLANKS = [9, 10, 11, 12, 13, 0x85]
_CONTRACTED = {ord("s"): 1, ord("t"): 1, ord("m"): 1, ord("d"): 1}
_CONTRACTED2 = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def kinds() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    global _kinds
    if _kinds is None:
        k = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))
            if g[0] == "L":
                k[c] = _LETTER
            elif g[0] == "N":
                k[c] = _NUMBER
            elif g[0] == "Z":
                k[c] = _SPACE
        k[_BLANKS] = _SPACE
        _kinds = k
    return _kinds


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, and their row."""
    # One entry per character: its first byte and its code point.
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    n = len(at)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    b = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64)
    c = b[at].copy()
    for low, high, width, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        i = np.flatnonzero((c >= low) & (c < high) & (data[at] >= low))
        if len(i):
            v = c[i] & mask
            for j in range(1, width):
                v = (v << 6) | (b[at[i] + j] & 0x3F)
            c[i] = v
    kind = kinds()[np.minimum(c, 0x10FFFF)]
    row_first = np.zeros(n, bool)
    edges = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    row_first[edges] = True
    run_first = row_first.copy()
    run_first[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(run_first)
    ends = np.concatenate((runs[1:], [n]))
    rk = kind[runs]
    ends_row = np.concatenate((row_first[runs[1:]], [True]))
    start = np.zeros(n, bool)
    start[runs] = True
    # White space before more text: its last character stands alone, or if it is a plain space leads the next run.
    sp = np.flatnonzero((rk == _SPACE) & ~ends_row)
    last = ends[sp] - 1
    start[last] = True
    lead_space = c[last] == 32
    start[ends[sp][lead_space]] = False
    # An apostrophe that begins a pre-token takes a contraction from the letters that follow.
    q = np.flatnonzero((rk == _OTHER) & (ends - runs == 1) & ~ends_row)
    q = runs[q][c[runs[q]] == 39]
    q = q[start[q]]
    q = q[kind[q + 1] == _LETTER]
    if len(q):
        cc = np.concatenate((c, [0, 0, 0]))
        rf = np.concatenate((row_first, [True, True, True]))
        one = np.isin(cc[q + 1], list(_CONTRACTED))
        two = np.zeros(len(q), bool)
        for x, y in _CONTRACTED2:
            two |= (cc[q + 1] == x) & (cc[q + 2] == y) & ~rf[q + 2]
        for hit, width in ((one, 2), (two, 3)):
            p = q[hit]
            start[p + 1] = False
            nxt = p + width
            nxt = nxt[nxt < n]
            start[nxt] = True
    s = np.flatnonzero(start)
    bs = at[s]
    be = np.concatenate((bs[1:], [len(data)]))
    return bs, be, np.searchsorted(offsets, bs, "right") - 1


def _single_piece(path: str):
    """A faster encoder of one pre-token from the same file, if its merges are in the order of their ids; else None."""
    import json

    import tiktoken

    with open(path) as f:
        whole = json.load(f)
    model = whole["model"]
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"] for x in whole["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(pairs)):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """ids(data, offsets) -> (ids end to end, ids per row), equal to the tokenizer's own on every text."""

    #: Distinct pre-tokens that are remembered.
    KEEP = 600_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.single = _single_piece(path)
        self.special = [t.encode() for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data, s, e, keys):
        if len(self.keys) + len(keys) > self.KEEP:
            self._clear()
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())]
        if self.single:
            got = list(map(self.single, texts))
        else:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))
        place = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate((self.ids, flat))
        k = np.concatenate((self.keys, keys))
        order = np.argsort(k, kind="stable")
        self.keys = k[order]
        self.place = np.concatenate((self.place, place))[order]
        self.count = np.concatenate((self.count, count))[order]

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        raw = data.tobytes()
        if any(t in raw for t in self.special):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, rows)
        s, e, row = boundaries(data, offsets)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        h = K.hashes(data, s, e)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            before = len(self.keys)
            self._learn(data, s[first[new]], e[first[new]], keys[new])
            if len(self.keys) < before + new.sum():  # the memory was cleared: what was known must be learnt again
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                again = self.keys[at] != keys
                if again.any():
                    keep, self.KEEP = self.KEEP, 1 << 62
                    self._learn(data, s[first[again]], e[first[again]], keys[again])
                    self.KEEP = keep
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][back]
        place = self.place[at][back]
        total = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - place, count)
        return self.ids[i], total
