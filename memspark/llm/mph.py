"""Minimal perfect hash over distinct 64-bit keys, by levels of collision-free bits, whole in NumPy."""

from __future__ import annotations

import numpy as np

from .common import mix64

LEVELS = 24


class MinimalPerfectHash:
    """Maps each of n distinct keys to one of 0..n-1. Other keys get any index or -1: callers compare a fingerprint."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[np.uint64, int, np.ndarray, np.ndarray]] = []
        self.n, base = len(keys), 0
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-int(len(keys) * gamma + 64) // 64) * 64
            seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
            at = mix64(keys ^ seed) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((seed, size, words, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            keys = keys[~alone[at]]
        self.rest, self.base = np.sort(keys), base

    def arrays(self) -> dict[str, np.ndarray]:
        """What the hash consists of, to be written; restored() takes it back."""
        out = {"seeds": np.array([x[0] for x in self.levels], np.uint64), "sizes": np.array([x[1] for x in self.levels], np.int64), "rest": self.rest, "counts": np.array([self.n, self.base], np.int64)}
        for k, (_, _, words, ranks) in enumerate(self.levels):
            out |= {f"words{k}": words, f"ranks{k}": ranks}
        return out

    @classmethod
    def restored(cls, a) -> MinimalPerfectHash:
        self = cls.__new__(cls)
        self.n, self.base, self.rest = int(a["counts"][0]), int(a["counts"][1]), a["rest"]
        self.levels = [(s, int(n), a[f"words{k}"], a[f"ranks{k}"]) for k, (s, n) in enumerate(zip(a["seeds"], a["sizes"], strict=True))]
        return self

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for seed, size, words, ranks in self.levels:
            if not len(todo):
                return out
            at = mix64(keys[todo] ^ seed) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (ranks[word] + below)[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.base + at[hit]
        return out
