"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker keeps at most.
MEMO_WORDS = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of a word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def words_of(raw: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased."""
    return raw.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than size are one shingle, none are none."""
    words = words_of(raw)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    folded = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        folded = (folded * _A + h[k : len(h) - size + 1 + k]) * _B
        folded ^= folded >> np.uint64(29)
    return np.unique(mix(folded))
