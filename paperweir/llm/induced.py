"""Suffix order of many short strings by induced sorting, with bucket queues that spill to disk."""

from __future__ import annotations

import os
import tempfile

import numpy as np


#: Characters whose kinds are told at a time.
BLOCK = 1 << 18


def place_type(n: int) -> type:
    """The type of positions in n characters: half as wide where that is enough."""
    return np.int32 if n < 1 << 31 else np.int64


class BucketQueue:
    """A monotone priority queue of suffix positions. Its keys are first characters; within a key, what is pushed first is
    smaller (or larger, on the way down), because suffixes are pushed in the order of their successors. Beyond `memory`
    bytes, what a key holds goes to its file in a folder of this process, removed on close."""

    def __init__(self, keys: int, memory: int, kind: type = np.int64):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(keys)]
        self.memory, self.held, self.folder, self.kind = memory, 0, None, kind

    def push(self, key: int, items: np.ndarray) -> None:
        self.parts[key].append(items)
        self.held += items.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="paperweir-")
        for key, parts in enumerate(self.parts):
            if parts:
                with open(os.path.join(self.folder.name, str(key)), "ab") as f:
                    for p in parts:
                        p.astype(self.kind).tofile(f)
                parts.clear()
        self.held = 0

    def pop(self, key: int) -> np.ndarray:
        parts, self.parts[key] = self.parts[key], []
        self.held -= sum(p.nbytes for p in parts)
        if self.folder:
            path = os.path.join(self.folder.name, str(key))
            if os.path.exists(path):
                parts.insert(0, np.fromfile(path, self.kind))
                os.remove(path)
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def _push(queue: BucketQueue, text: np.ndarray, at: np.ndarray, own: int) -> np.ndarray:
    """Pushes positions by their character, in order; returns those of the bucket in hand."""
    ch = text[at]
    order = np.argsort(ch, kind="stable")
    at, ch = at[order], ch[order]
    cuts = np.flatnonzero(np.diff(ch)) + 1
    mine = np.zeros(0, at.dtype)
    for part in np.split(at, cuts):
        if len(part):
            key = int(text[part[0]])
            if key == own:
                mine = part
            else:
                queue.push(key, part)
    return mine


def induce(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, memory: int) -> np.ndarray:
    """Order of all suffixes, given the order of the S* ones (0 ends each string; those suffixes keep the order given)."""
    keys = int(text.max()) + 1
    star_char = text[stars]
    first = np.searchsorted(star_char, np.arange(keys + 1))
    kind = place_type(len(text))
    up, down = BucketQueue(keys, memory, kind), BucketQueue(keys, memory, kind)
    falling: list[np.ndarray] = []
    try:
        for c in range(keys):
            done = []
            front = up.pop(c)
            while len(front):
                done.append(front)
                before = front - 1
                before = before[(before >= 0)]
                front = _push(up, text, before[~is_s[before]], c)
            s = stars[first[c] : first[c + 1]]
            before = s - 1
            before = before[before >= 0]
            _push(up, text, before[~is_s[before]], -1)
            falling.append(np.concatenate(done) if done else np.zeros(0, kind))
        out: list[np.ndarray] = []
        for c in range(keys - 1, 0, -1):
            done = []
            front = down.pop(c)
            while len(front):
                done.append(front)
                before = front - 1
                before = before[before >= 0]
                front = _push(down, text, before[is_s[before] & (text[before] > 0)], c)
            low = falling[c]
            before = low[::-1] - 1
            before = before[before >= 0]
            _push(down, text, before[is_s[before] & (text[before] > 0)], -1)
            falling[c] = np.zeros(0, kind)
            out.append(np.concatenate(done)[::-1] if done else np.zeros(0, kind))
            out.append(low)
        out.append(stars[first[0] : first[1]])
        return np.concatenate(out[::-1])
    finally:
        up.close()
        down.close()


def kinds(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S). A 0 is always S."""
    n, after = len(text), True
    is_s = np.empty(n, bool)
    for lo in reversed(range(0, n, BLOCK)):
        # With the first of what follows; a run that goes on there is of its kind.
        part, size = text[lo : lo + BLOCK + 1], min(BLOCK, n - lo)
        differs = np.flatnonzero(part[1:] != part[:-1])
        rises = np.append(part[differs + 1] > part[differs], after)
        is_s[lo : lo + size] = np.repeat(rises, np.diff(differs, prepend=-1, append=size - 1))
        after = is_s[lo]
    is_s[text == 0] = True
    return is_s


def order_names(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names in which the last of each part is unique: ranks are refined by doubling."""
    kind = place_type(len(names))
    rank = names.astype(kind)

    def leads(new: np.ndarray) -> np.ndarray:
        """For each of a row of elements, where the group begins that it is in; new: whether it begins one."""
        lead = np.arange(len(new), dtype=kind)
        lead[~new] = 0
        return np.maximum.accumulate(lead, out=lead)

    order = np.argsort(rank, kind="stable").astype(kind)
    r = rank[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))[: len(r)]
    del r
    rank[order] = leads(new)
    todo = np.sort(order[~(new & np.append(new[1:], True)[: len(new)])])
    del order, new
    step = 1
    while len(todo):
        was = rank[todo]
        key = rank[np.minimum(todo + step, len(rank) - 1)]
        o = np.lexsort((key, was)).astype(kind)
        t, k, r = todo[o], key[o], was[o]
        del o, key, was
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new = new_group | np.concatenate(([True], k[1:] != k[:-1]))
        del k
        r += leads(new)
        r -= leads(new_group)
        rank[t] = r
        todo = t[~(new & np.append(new[1:], True))]
        step *= 2
    return rank


def suffix_order(text: np.ndarray, memory: int = 256 << 20) -> np.ndarray:
    """Positions of `text` in suffix order. text: characters from 1 on, each string closed by a 0; closing zeros are ordered
    by place, so no comparison runs past the end of a string.

    S* suffixes are sorted by inducing their substrings, naming them and sorting the string of names, a third as long at
    most; from their order the rest is induced."""
    is_s = kinds(text)
    star = is_s.copy()
    star[1:] &= ~is_s[:-1]
    star[0] = False
    star[text == 0] = True
    stars = np.flatnonzero(star).astype(place_type(len(text)))
    by_char = stars[np.argsort(text[stars], kind="stable")]
    order = induce(text, is_s, by_char, memory)
    sorted_stars = order[star[order]]
    del order, by_char, star
    # Names: two neighbours share one if their substrings, up to and including the next S*, are equal.
    which = np.searchsorted(stars, sorted_stars).astype(stars.dtype)
    length = (np.minimum(np.append(stars[1:], len(text)), len(text) - 1) + 1 - stars)[which]
    same = np.zeros(len(sorted_stars), bool)
    a, b = sorted_stars[:-1], sorted_stars[1:]
    live = np.flatnonzero((length[1:] == length[:-1]) & (text[a] > 0) & (text[b] > 0)).astype(stars.dtype)
    # A substring that ends at a string's own 0 is followed by nothing that may be compared: it is nobody's equal but by rank.
    same[1:][live] = True
    at = 0
    while len(live):
        ok = text[a[live] + at] == text[b[live] + at]
        same[1:][live[~ok]] = False
        at += 1
        live = live[ok & (length[1:][live] > at)]
    names = np.zeros(len(stars), stars.dtype)
    names[which] = np.cumsum(~same)
    del which, length, same, a, b, live, sorted_stars
    rank = order_names(names)
    del names
    stars_sorted = stars[np.argsort(rank, kind="stable")]
    del rank, stars
    return induce(text, is_s, stars_sorted, memory)
