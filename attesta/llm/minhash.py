"""MinHash signatures of sets of 64-bit hashes, bands, and odd sketches."""

from __future__ import annotations

import numpy as np

from .common import mix64


def seeds(k: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    raw = mix64(np.arange(2 * k, dtype=np.uint64) + np.uint64(salt << 32))
    return (raw[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (raw[k:] >> np.uint64(32)).astype(np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k minima (uint32) for each of the sets hashes[first[i]:first[i + 1]]; sets are not empty."""
    a, b = seeds(k)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, k), np.uint32)
    step = 1 << 16
    mixed = np.empty(step, np.uint32)
    # In pieces that stay in the cache; each piece ends with a set, unless one set is longer.
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, "right")) - 1)
        part, at = x[first[lo] : first[hi]], (first[lo:hi] - first[lo]).astype(np.intp)
        if len(part) > len(mixed):
            mixed = np.empty(len(part), np.uint32)
        now = mixed[: len(part)]
        for i in range(k):
            np.multiply(part, a[i], out=now)
            np.add(now, b[i], out=now)
            out[lo:hi, i] = np.minimum.reduceat(now, at)
        lo = hi
    return out


def bands(sig: np.ndarray, rows: int, count: int) -> np.ndarray:
    """A 64-bit bucket for each of count bands of so many signature rows."""
    out = np.empty((len(sig), count), np.uint64)
    for j in range(count):
        h = np.full(len(sig), j + 1, np.uint64)
        for i in range(j * rows, (j + 1) * rows):
            h = mix64(h ^ sig[:, i].astype(np.uint64))
        out[:, j] = h
    return out.view(np.int64)


def odd_sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: each sample (its index and value) flips one of so many bits."""
    flags = np.zeros((len(sig), bits), np.uint8)
    rows = np.arange(len(sig))
    for i in range(sig.shape[1]):
        at = mix64(sig[:, i].astype(np.uint64) | np.uint64(i << 32)) % np.uint64(bits)
        flags[rows, at.astype(np.intp)] ^= 1
    return np.packbits(flags, axis=1)


def odd_limit(samples: int, bits: int, similarity: float) -> int:
    """The XOR population count expected at a similarity: samples differ in 2 k (1 - J) flips."""
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))))
