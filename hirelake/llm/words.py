"""Words of a text as integers, shared by the operators that compare word sequences."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters or digits.
WORD = re.compile(r"[^\W_]+")

_SEED = np.random.Generator(np.random.PCG64(20250203))
#: Odd multipliers for hashes of word sequences of up to 32 words.
MULTIPLIERS = _SEED.integers(1, 2**63, size=32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; forgets all when it holds `most` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class WordIds(dict):
    """word -> 1, 2, 3 ... in order of first use."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self) + 1
        return value


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hash_words(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def sequence_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for all positions with n words left."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = ids[:count] * MULTIPLIERS[0]
    for k in range(1, n):
        total += ids[k : k + count] * MULTIPLIERS[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total
