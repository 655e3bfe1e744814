"""Word shingles of a batch of texts as 64-bit hashes, in NumPy over the raw bytes."""

from __future__ import annotations

import numpy as np

from .common import WS, mix64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[list(WS)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 1 << 20


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def words(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word [^\\x20\\x09-\\x0D]+, and per text the number of its first word (n + 1 of them). fold: A-Z as a-z."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[(off > 0) & (off < len(data))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    begin = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), begin
    ends = np.append(starts[1:], len(data))
    powers = _powers(int((ends - starts).max()))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in steps, to bound the 8-byte arrays
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _STEP)))
        a, z = starts[at], ends[to - 1]
        part = data[a:z]
        value = (_FOLD[part] if fold else part).astype(np.uint64)
        value += np.uint64(1)
        value *= inside[a:z]
        here = starts[at:to] - a
        value *= powers[np.arange(z - a) - np.repeat(here, ends[at:to] - starts[at:to])]
        out[at:to] = np.add.reduceat(value, here)
        at = to
    return mix64(out), begin


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct n-word shingles; fewer words make one shingle of all; no word makes an empty set."""
    w, begin = words(data, off)
    factor = _powers(n + 1, np.uint64(0xD6E8FEB86659FD93))[1:]
    if len(w) >= n:
        s = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            s += w[k : len(w) - n + 1 + k] * factor[k]
        s = mix64(s)
    out = []
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if z - a >= n:
            u = np.sort(s[a : z - n + 1])
            out.append(u[np.append(True, u[1:] != u[:-1])])
        elif z > a:
            h = z - a
            for x in w[a:z].tolist():
                h = (h * 0x2545F4914F6CDD1D + x) & (2**64 - 1)
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
