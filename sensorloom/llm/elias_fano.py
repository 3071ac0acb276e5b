"""Elias-Fano coding of a non-decreasing sequence, with constant-time access to its elements.

Each of n values below u is split: the low log2(u / n) bits are packed side by side, the rest is written in unary into a bit
vector, where the i-th one stands at (value >> low bits) + i. A select directory holds every 256th one's place in 32
bits, so an element takes one jump and a short scan. In all about 2 + log2(u / n) bits an element, and no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256  # ones between two entries of the select directory
HEAD = "<QQBxxx"  # values, bits of the upper part, low bits
BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """``values``: non-negative, non-decreasing, below 2^63."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    if n and (np.any(v[1:] < v[:-1]) or top >= 1 << 63):
        raise ValueError("values must be non-decreasing and below 2^63")
    low = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 1 if n else 0
    if size >= 1 << 32:
        raise ValueError("too many values for one sequence")
    upper = np.zeros(-(-size // 8), np.uint8)
    np.bitwise_or.at(upper, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    lows = np.zeros((n, low), np.uint8)
    for b in range(low):
        lows[:, b] = (v >> np.uint64(b)) & np.uint64(1)
    packed = np.packbits(lows.ravel(), bitorder="little")
    return struct.pack(HEAD, n, size, low) + ones[::STEP].astype("<u4").tobytes() + upper.tobytes() + packed.tobytes()


class Sequence:
    """A coded sequence at ``at`` in ``data``. ``end`` is the place behind it."""

    def __init__(self, data, at: int = 0):
        self.n, self.size, self.low = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        jumps, upper = -(-self.n // STEP), -(-self.size // 8)
        self.jumps = np.frombuffer(data, "<u4", jumps, at)
        self.upper = np.frombuffer(data, np.uint8, upper, at + 4 * jumps)
        at += 4 * jumps + upper
        self.lows = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)
        self.end = at + len(self.lows)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The place of the i-th one in the upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.jumps[i // STEP]), i % STEP
        byte = place >> 3
        left += bin(int(self.upper[byte]) & ((1 << (place & 7)) - 1)).count("1")  # ones of this byte before the jump's
        while (ones := int(BYTE_ONES[self.upper[byte]])) <= left:
            left -= ones
            byte += 1
        bits = int(self.upper[byte])
        for _ in range(left):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        first = i * self.low
        raw = int.from_bytes(self.lows[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return (self.select(i) - i) << self.low | raw >> (first & 7) & ((1 << self.low) - 1)

    def rank(self, value: int) -> int:
        """How many elements are below ``value``, by a binary search over ``select``."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] < value else (lo, mid)
        return lo

    def all(self) -> np.ndarray:
        """All elements, for whoever reads on from the first to the last."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        for b in range(self.low):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out.astype(np.int64)
