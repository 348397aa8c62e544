"""Hashed word shingles of texts, as numpy arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words whose hashes a task remembers at a time.
REMEMBERED = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words; a shorter text is one run, an empty one has none."""
    n = len(hashes)
    width = min(k, n)
    if not n:
        return hashes
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * ODD + hashes[i : n - width + 1 + i])
    return out


def ascii_words(text: str | None) -> list[bytes]:
    """Words split at ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
