"""Vectorised words and rolling hashes over UTF-8 bytes laid end to end."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing; every byte of a non-ASCII character is one.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of [^\x20\x09-\x0D].
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2**64 for i < n."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        _tables[base] = (out[0], out[1])
    return _tables[base]


def forget() -> None:
    """Drops the tables of powers: a fit on the driver need not leave them behind."""
    _tables.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of true bytes; runs never cross a row."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = inside[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each data[s:e]; another odd base gives another hash."""
    p, inv = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * inv[s])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, U)
    p, inv = powers(_WORD_BASE, len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inv[: len(h) - n + 1] + U(n))


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)
