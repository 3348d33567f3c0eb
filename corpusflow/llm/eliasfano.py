"""Elias-Fano coded monotone sequences with vectorised successor search, laid out for memory mapping."""

from __future__ import annotations

import numpy as np

POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: The place of the r-th set bit of a byte.
NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        NTH[_b, _r] = _p
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class EliasFano:
    """n ascending numbers below `universe`, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.low_bits, self.lows, self.highs, self.zeros = n, low_bits, lows, highs, zeros
        self.ones: np.ndarray | None = None
        self.values: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(-(-(n + (universe >> low_bits) + 2) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = POP[highs.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
        zeros = 64 * np.arange(len(highs)) - (np.cumsum(ones) - ones)
        lows = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            low = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lows[word[first]] |= np.bitwise_or.reduceat(low << off, first)
            over = off.astype(np.int64) + low_bits > 64
            lows[word[over] + 1] |= low[over] >> (np.uint64(64) - off[over])
        return cls(n, low_bits, lows, highs, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.lows, self.highs, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) among the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rank = k - self.zeros[word]
        raw = (self.highs[word] ^ ALL).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(POP[raw], 1, dtype=np.int64)
        byte = (upto <= rank[:, None]).sum(1)
        rows = np.arange(len(k))
        before = np.where(byte > 0, upto[rows, byte - 1], 0)
        return 64 * word + 8 * byte + NTH[raw[rows, byte], rank - before]

    def low(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), np.uint64)
        at = k.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(off > 0, self.lows[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((self.lows[word] >> off) | upper) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """How many numbers are below each x: the place of its successor."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        below = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        end = self.select0(high) - high
        want = x & np.uint64((1 << self.low_bits) - 1)
        a, b = below, end
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) >> 1
            less = self.low(mid) < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)

    def all(self) -> np.ndarray:
        """The numbers, decoded; kept for the next search."""
        if self.values is None:
            at = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))[: self.n]
            k = np.arange(self.n)
            self.values = ((at - k).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(k)
        return self.values

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x (the first of equal ones), -1 where it isn't there. Many searches decode the sequence once."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        if self.values is not None or 8 * len(x) >= self.n:
            at = np.searchsorted(self.all(), x)
            return np.where(self.values[np.minimum(at, self.n - 1)] == x, at, -1)
        at = self.successor(x)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        end = self.select0(high) - high
        inside = at < end
        same = inside & (self.low(np.minimum(at, self.n - 1)) == (x & np.uint64((1 << self.low_bits) - 1)))
        return np.where(same, at, -1)

    def get(self, k: np.ndarray) -> np.ndarray:
        """The k-th numbers."""
        if not len(k):
            return np.zeros(0, np.uint64)
        if self.values is not None:
            return self.values[k]
        if self.ones is None:
            self.ones = 64 * np.arange(len(self.zeros)) - self.zeros
        word = np.searchsorted(self.ones, k, "right") - 1
        rank = k - self.ones[word]
        raw = self.highs[word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(POP[raw], 1, dtype=np.int64)
        byte = (upto <= rank[:, None]).sum(1)
        rows = np.arange(len(k))
        before = np.where(byte > 0, upto[rows, byte - 1], 0)
        place = 64 * word + 8 * byte + NTH[raw[rows, byte], rank - before]
        return ((place - k).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(k)
