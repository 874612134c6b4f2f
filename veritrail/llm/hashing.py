"""Vectorised hashes of words, shingles and their minima."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
MAX_KNOWN = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KNOWN:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place where size words stand."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(size):
            out = mixed(out + hashes[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def minima(values: np.ndarray, times: np.ndarray, plus: np.ndarray, block: int = 1024) -> np.ndarray:
    """For each hash function the smallest value; values may be many, so they go by blocks."""
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), block):
        np.minimum(low, (times[:, None] * values[None, at : at + block] + plus[:, None]).min(axis=1), out=low)
    return low
