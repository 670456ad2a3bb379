"""MinHash sketches of shingle sets, whole batches at a time."""

from __future__ import annotations

import numpy as np

from .words import mix

_BLOCK = 1 << 16


class MinHash:
    """bands * rows minima of universal hash functions h(x) = ((a * x + b) mod 2^64) >> 32 with odd a,
    where x is the 32-bit fold of a shingle's hash (multiply-shift, strongly universal for 32-bit x)."""

    def __init__(self, bands: int, rows: int, seed: int = 17) -> None:
        self.bands, self.rows = bands, rows
        random = np.random.Generator(np.random.PCG64(seed))
        self.a = random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def minima(self, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have shingles, and for each the minima (uint32; hashes down, rows across).
        row is ascending."""
        new = np.ones(len(row), dtype=bool)
        new[1:] = row[1:] != row[:-1]
        first = np.flatnonzero(new)
        out = np.full((len(self.a), len(first)), 2**32 - 1, dtype=np.uint64)
        x = (value ^ (value >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
        at = 0
        while at < len(x):  # blocks that stay in the processor's cache
            to = min(at + _BLOCK, len(x))
            lo, hi = int(np.searchsorted(first, at, side="right")) - 1, int(np.searchsorted(first, to))
            starts = np.maximum(first[lo:hi], at) - at
            part, work = x[at:to], np.empty(to - at, dtype=np.uint64)
            for i in range(len(self.a)):
                np.multiply(part, self.a[i], out=work)
                work += self.b[i]
                least = np.minimum.reduceat(work, starts) >> np.uint64(32)
                np.minimum(out[i, lo:hi], least, out=out[i, lo:hi])
            at = to
        return row[first], out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band (rows down, bands across); the band's number is part of it."""
        out = np.zeros((minima.shape[1], self.bands), dtype=np.uint64)
        for band in range(self.bands):
            key = np.full(minima.shape[1], band + 1, dtype=np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[i])
            out[:, band] = key
        return out

    def least_agreement(self, similarity: float, error: float = 1e-9) -> int:
        """The number of equal minima below which two sets of at least this similarity fall with a
        probability under `error` (binomial tail)."""
        n, p = len(self.a), similarity
        tail, term = 0.0, (1 - p) ** n
        for k in range(n + 1):
            tail += term
            if tail > error:
                return k
            term *= (n - k) / (k + 1) * p / (1 - p)
        return n


def fingerprint(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set of shingles (order does not count)."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    count = np.diff(np.append(first, len(row))).astype(np.uint64)
    return mix(np.add.reduceat(mix(value), first) + count), mix(np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), first) ^ count)
