"""Words and word shingles as 64-bit hashes, for Arrow workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """word -> hash. It is emptied when it has grown to `most` words, so its memory is bounded."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    """The hashes of a text's words (runs of letters, digits and underscores, in lower case), in order."""
    return np.array([known[w] for w in WORD.findall(text.lower())], np.uint64)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by the first word's position. Fewer than k words make one run of them all."""
    k = min(k, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j : len(words) - k + 1 + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out
