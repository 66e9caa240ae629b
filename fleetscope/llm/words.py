"""Word hashes of whole texts inside tasks, on the UTF-8 bytes of Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Words a worker remembers the hash of before it starts anew; bounds its memory.
REMEMBERED = 1 << 18

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@cache
def word_hashes() -> WordHashes:
    """The worker process's own table; it serves one task after the other."""
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _MIX[0]
    x = (x ^ (x >> _S30)) * _MIX[1]
    x = (x ^ (x >> _S27)) * _MIX[2]
    return x ^ (x >> _S31)


def lower_words(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: what ``bytes`` methods do."""
    return data.lower().split()


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    runs = words[: n - width + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, width):
            runs = runs * _BASE + words[i: n - width + 1 + i]
        runs = mixed(runs + np.uint64(width))
    return np.unique(runs)
