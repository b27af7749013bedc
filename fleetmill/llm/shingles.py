"""Word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def word_hashes(raw: bytes | None, lower: bool = True) -> np.ndarray:
    """A hash for each word: bytes.split() parts at exactly the six ASCII spaces, bytes.lower() lowers A-Z only."""
    if not raw:
        return np.empty(0, np.uint64)
    parts = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """One hash for each window, of the words at the given places of it."""
    n = len(h) - max(places)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(places)))
    for p in places:
        out = mixed(out * _A + h[p : p + n] * _B)
    return out


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence as one if there are fewer words; else none."""
    h = word_hashes(raw)
    if not len(h):
        return h
    return np.unique(window_hashes(h, tuple(range(min(k, len(h))))))
