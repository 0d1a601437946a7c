"""Words of a text as 64-bit hashes, and shingles of five of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier for each place in a shingle.
_PLACE = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k * 0x165667B19E3779F9) % (1 << 64) | 1 for k in range(SHINGLE)], np.uint64)


class WordHashes(dict):
    """Hash of a word, computed once while it is remembered; what is remembered is bounded."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self) > self.most:
            self.clear()
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; a shorter text is one shingle, a text without words none."""
    n = len(h)
    if not n:
        return h
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, (n if n < SHINGLE else 0) * 0x165667B19E3779F9 % (1 << 64), np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i] * _PLACE[i]
    return mix(out)
