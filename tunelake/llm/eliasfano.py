"""Monotone integer sequences in Elias-Fano form, read by whole arrays of queries.

A sequence of n values below u is kept as the low l = log2(u / n) bits of each
value, packed, and the high parts as a bit string with a 1 for each value and
a 0 where the high part grows: about 2 + l bits a value. ``ranks`` holds the
number of ones before each 64-bit word, so that the k-th one or zero is found
by a binary search over words and a table of bytes."""

from __future__ import annotations

import numpy as np

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
_ONES = _BITS.sum(1).astype(np.int64)
#: place of the k-th one (row 1) or zero (row 0) of a byte
_PLACE = np.zeros((2, 256, 8), np.int64)
for _b in range(256):
    for _v in (0, 1):
        _at = np.flatnonzero(_BITS[_b] == _v)
        _PLACE[_v, _b, :len(_at)] = _at


#: Values that are taken apart at once; a multiple of 8, so that their low bits fill whole bytes.
SLICE = 1 << 16


def encode(values: np.ndarray) -> dict[str, bytes]:
    """The parts of the sequence (non-negative, ascending) as bytes."""
    values = np.asarray(values, np.int64)
    n = len(values)
    low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
    bits = np.zeros(((int(values[-1]) >> low_bits if n else 0) + n + 64) // 64 * 64 + 64, np.uint8)
    lows = []
    for a in range(0, n, SLICE):
        some = values[a:a + SLICE]
        bits[(some >> low_bits) + np.arange(a, a + len(some))] = 1
        low = np.empty((len(some), low_bits), np.uint8)
        for j in range(low_bits):
            low[:, j] = (some >> j) & 1
        lows.append(np.packbits(low, bitorder="little").tobytes())
    words = np.packbits(bits, bitorder="little")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))])
    return {"head": np.array([n, low_bits], np.int64).tobytes(), "high": words.tobytes(), "ranks": ones.tobytes(),
            "low": b"".join(lows) + bytes(16)}


class Sequence:
    """Reads the parts made by ``encode``; they may be memory-mapped."""

    def __init__(self, head, high, ranks, low):
        self.n, self.low_bits = (int(x) for x in np.asarray(head).view(np.int64))
        self.high, self.low = np.asarray(high), np.asarray(low)
        self.ranks = np.asarray(ranks).view(np.int64)
        self.zeros = None

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the high string."""
        if bit:
            before = self.ranks
        else:
            if self.zeros is None:
                self.zeros = 64 * np.arange(len(self.ranks), dtype=np.int64) - self.ranks
            before = self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        eight = self.high.reshape(-1, 8)[word]
        each = _ONES[eight] if bit else 8 - _ONES[eight]
        upto = np.cumsum(each, axis=1)
        byte = (upto <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        rest = rest - (upto[row, byte] - each[row, byte])
        return word * 64 + byte * 8 + _PLACE[bit][eight[row, byte], rest]

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """How many ones follow without a zero from the bit ``at`` on; 56 or more where they fill the 8 bytes read."""
        raw = np.ascontiguousarray(self.high[(at >> 3)[:, None] + np.arange(8)]).view(np.uint64)[:, 0]
        zeros = ~(raw >> (at & 7).astype(np.uint64))
        lowest = zeros & (~zeros + np.uint64(1))
        return np.log2(np.where(lowest, lowest, np.uint64(1) << np.uint64(63)).astype(np.float64)).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        raw = np.ascontiguousarray(self.low[(at >> 3)[:, None] + np.arange(8)]).view(np.uint64)[:, 0]
        return ((raw >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i) << self.low_bits) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in a strictly ascending sequence; -1 where it is absent."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = x >> self.low_bits
        top = int(self.__getitem__(np.array([self.n - 1]))[0]) >> self.low_bits
        inside = np.flatnonzero((x >= 0) & (h <= top))
        if not len(inside):
            return out
        h = h[inside]
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) + 1, 0)  # the bit after the zero that begins the bucket
        lo = first - h
        ones = self._ones_from(first)
        end = lo + ones
        if len(many := np.flatnonzero(ones >= 56)):
            end[many] = self._select(h[many], 0) - h[many]
        want = x[inside] & ((1 << self.low_bits) - 1)
        hi = end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):  # first place of the bucket not below x
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        there = lo < end
        there[there] = self._lows(lo[there]) == want[there]
        out[inside[there]] = lo[there]
        return out
