"""Word shingles as sorted arrays of 64-bit hashes, for the Python sides of the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_CACHE_MAX = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    return (h ^ (h >> np.uint64(32))) * _M2


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; A-Z lower-cased, words split at ASCII white space.

    A text with fewer words gives its whole sequence as one shingle; without words, an empty array.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for k in range(min(size, len(w))):
        h = mix(h + w[k : k + n])
    return np.unique(h)
