"""Words, their hashes, and shingles as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; keeps the first ``held`` words, which are mostly frequent ones."""

    def __init__(self, held: int = 200_000):
        super().__init__()
        self.held = held

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.held:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for every run of ``size`` consecutive hashes, order included."""
    total = hashes[:len(hashes) - size + 1] + np.uint64(size)
    for i in range(1, size):
        total = mixed(total) + hashes[i:i + len(total)]
    return mixed(total)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, sorted; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    return np.unique(chained(hashes, min(size, len(hashes))))
