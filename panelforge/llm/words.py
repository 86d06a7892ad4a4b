"""Words of texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept in a worker's table before it starts anew.
TABLE = 150_000


class WordHashes(dict):
    """Word to hash; a word that isn't there yet is hashed."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= TABLE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def hashed(words: list) -> np.ndarray:
    """The hash of each word."""
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number over all bits of another, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors for the places of a window.
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
