"""Shingle sets of texts as sorted arrays of 64-bit hashes, and their minwise tokens."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0xFF51AFD7ED558CCD)
MUL = np.uint64(0x9E3779B97F4A7C15)
COORDINATES = 64
_draw = np.random.RandomState(20240229)
SEEDS = _draw.randint(0, 2**62, COORDINATES, dtype=np.int64).astype(np.uint64)
ODDS = _draw.randint(0, 2**62, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of width words; fewer words make one shingle, none make none.

    Words are lower-cased in A-Z and separated by ASCII white space, which bytes.split() does.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= MUL
        out ^= h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    if k < width:  # a short text differs from a window of the same words
        out += np.uint64(k)
    out ^= out >> np.uint64(33)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minwise(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set, COORDINATES minwise tokens of 32 bits; sets are concatenated and none is empty."""
    tokens = np.empty((len(starts), COORDINATES), np.uint32)
    for t in range(COORDINATES):
        low = np.minimum.reduceat((sets ^ SEEDS[t]) * ODDS[t], starts)
        low ^= low >> np.uint64(32)
        tokens[:, t] = (low * MIX) >> np.uint64(32)
    return tokens
