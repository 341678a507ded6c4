"""Word shingles of whole texts as sorted sets of 64-bit hashes (helpers for tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
#: Entries of the word memo before it starts anew.
MEMO = 500_000


class WordHashes(dict):
    """Memo from a word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: runs of ``width`` words, or all words where there are fewer.

    bytes.lower() changes A-Z alone and bytes.split() cuts at ASCII white space alone, for any UTF-8 text.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    w = min(n, width)
    s = h[: n - w + 1] * _ODD[0]
    for i in range(1, w):
        s = scrambled(s) + h[i : n - w + 1 + i] * _ODD[i]
    return np.unique(scrambled(s + np.uint64(w)))

