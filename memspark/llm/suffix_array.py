"""Two-stage suffix sorting, whole in NumPy: sort the suffixes smaller than their successors, induce the rest."""

from __future__ import annotations

import numpy as np


class Words:
    """The 8 bytes from any position of a text, as big-endian numbers. padded: the text goes depth + 16 bytes on, so it needs no copy."""

    def __init__(self, text: np.ndarray, depth: int, padded: bool = False):
        self.n, self.depth = len(text) - (depth + 16 if padded else 0), depth
        pad = text if padded else np.zeros(self.n + depth + 16, np.uint8)
        if not padded:
            pad[: self.n] = text
        self.view = np.ndarray((self.n + depth + 8,), ">u8", buffer=pad.data, strides=(1,))

    def at(self, where: np.ndarray) -> np.ndarray:
        return self.view[where].astype(np.uint64)


def sort_directly(where: np.ndarray, words: Words) -> np.ndarray:
    """Positions sorted by the bytes that follow, to the depth and 8 bytes more; only ties are looked at again."""
    if not len(where):
        return where
    key = words.at(where)
    order = np.argsort(key, kind="stable")
    where, key = where[order], key[order]
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    for k in range(8, words.depth + 8, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        g, sub = group[tied], where[tied]
        key = words.at(sub + k)
        order = np.lexsort((key, g))
        sub, key = sub[order], key[order]
        where[tied] = sub
        step = np.zeros(len(group), np.int64)
        step[1:] = group[1:] != group[:-1]
        step[tied[1:]] |= (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(step)
    return where


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions where `wanted` holds, in the order of the suffixes' first `depth` bytes.

    A suffix smaller than its successor is sorted directly (B); any other (A) takes its place in the bucket of its
    first byte from the place of its successor, in one scan over the buckets from small to large.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    turn = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # last of each run of one byte
    rises = np.append(text[turn[:-1]] < text[turn[:-1] + 1], False)
    is_b = np.repeat(rises, np.diff(np.append(-1, turn)))
    # An A-suffix needs its successors, up to and with the next B-suffix.
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(wanted, index, -1))
    begin = np.maximum.accumulate(np.append(0, np.where(is_b[:-1], index[1:], 0)))
    need = last >= begin
    words = Words(text, depth)
    b_sorted = sort_directly(np.flatnonzero(need & is_b), words)
    b_cut = np.searchsorted(text[b_sorted], np.arange(257))
    need_a = need & ~is_b
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    tail = np.flatnonzero(need_a[-1:]) + n - 1  # the last suffix has no successor: it comes first in its bucket
    if len(tail):
        queue[text[-1]].append(tail)
    out = []
    for c in range(256):
        parts, at = queue[c], 0
        while at < len(parts):  # runs of one byte induce within their bucket
            before = parts[at] - 1
            before = before[before >= 0]
            before = before[need_a[before] & (text[before] == c)]
            if len(before):
                parts.append(before)
            at += 1
        bucket = np.concatenate([*parts, b_sorted[b_cut[c] : b_cut[c + 1]]])
        queue[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[need_a[before]]
        char = text[before]
        before, char = before[char > c], char[char > c]
        order = np.argsort(char, kind="stable")
        before, char = before[order], char[order]
        cut = np.flatnonzero(char[1:] != char[:-1]) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(char)], strict=True):
            if z > a:
                queue[char[a]].append(before[a:z])
    sa = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
    return sa[wanted[sa]]


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int, words: Words | None = None) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in `sa`, up to `depth`; 0 for the first."""
    lcp = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return lcp
    words, todo = Words(text, depth) if words is None else words, np.arange(1, len(sa))
    for k in range(0, depth, 8):
        x = words.at(sa[todo] + k) ^ words.at(sa[todo - 1] + k)
        same = np.full(len(todo), 8, np.int64)
        odd = x != 0
        same[odd] = 7 - (np.floor(np.log2((x[odd] >> np.uint64(1)).astype(np.float64) * 2 + 1)).astype(np.int64) >> 3)
        lcp[todo] += same
        todo = todo[~odd]
    return np.minimum(lcp, depth)
