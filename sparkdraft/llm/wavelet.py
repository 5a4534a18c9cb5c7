"""Wavelet tree over a permutation, level by level in flat bit planes."""

from __future__ import annotations

import numpy as np


class _Plane:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, dtype=np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), dtype=np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletTree:
    """Range queries over ``values``, non-negative integers below their number.

    A level keeps one bit of every value, the values being ordered by the
    bits above it, so it takes about a bit and a half a value. All queries
    take arrays and answer them together, one level at a time.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.planes = []
        for b in range(self.bits - 1, -1, -1):
            ones = (values >> b & 1).astype(bool)
            self.planes.append(_Plane(ones))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than x (at most the number of values)."""
        count = np.zeros(len(x), dtype=np.int64)
        for b, plane in zip(range(self.bits - 1, -1, -1), self.planes):
            lo1, hi1 = plane.ones(lo), plane.ones(hi)
            up = (x >> b & 1).astype(bool)
            count += np.where(up, (hi - hi1) - (lo - lo1), 0)
            lo = np.where(up, plane.zeros + lo1, lo - lo1)
            hi = np.where(up, plane.zeros + hi1, hi - hi1)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[lo:hi]; k is below hi - lo."""
        out = np.zeros(len(k), dtype=np.int64)
        for b, plane in zip(range(self.bits - 1, -1, -1), self.planes):
            lo1, hi1 = plane.ones(lo), plane.ones(hi)
            zeros = (hi - hi1) - (lo - lo1)
            up = k >= zeros
            out |= up.astype(np.int64) << b
            k = np.where(up, k - zeros, k)
            lo = np.where(up, plane.zeros + lo1, lo - lo1)
            hi = np.where(up, plane.zeros + hi1, hi - hi1)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest of values[lo:hi] that is at least x; -1 if there is none."""
        k = self.below(lo, hi, x)
        out = np.full(len(x), -1, dtype=np.int64)
        some = np.flatnonzero(k < hi - lo)
        out[some] = self.smallest(lo[some], hi[some], k[some])
        return out
