"""Elias-Fano coding of a non-decreasing sequence, with a select structure.

The low bits of the values are packed; the high parts are unary in a bit vector in which the
one of value i stands at ``high(i) + i``.  ``select`` finds it from a sampled directory of
32-bit offsets and a popcount of a few words, so an offset costs about
``2 + log2(universe / n)`` bits and no table of 64-bit numbers is kept.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

HEAD = struct.Struct("<QQBxxxIII")
SAMPLE = 256


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, packed, as bytes."""
    out = [np.zeros(0, np.uint8)]
    for at in range(0, len(values) if bits else 0, 1 << 16):
        part = values[at : at + (1 << 16)]
        out.append(((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
    return np.packbits(np.concatenate(out), bitorder="little")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of numbers below 2**63."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    at = high + np.arange(n)
    size = int(at[-1]) + 1 if n else 0
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[at] = 1
    upper = np.packbits(bits, bitorder="little")
    lower = _pack(values, low_bits)
    samples = at[::SAMPLE].astype("<u4")
    return HEAD.pack(n, top, low_bits, len(lower), len(upper), len(samples)) + lower.tobytes() + upper.tobytes() + samples.tobytes()


class Reader:
    """Random and bulk access to an encoded sequence: only the header is kept, the rest is read in slices."""

    def __init__(self, data: bytes | memoryview | Callable[[int, int], bytes]):
        """``data`` is the code, or a function that gives ``n`` bytes of it from an offset: (offset, n) -> bytes."""
        self.read = data if callable(data) else lambda at, n: bytes(data[at : at + n])
        self.n, self.top, self.low_bits, a, b, c = HEAD.unpack(self.read(0, HEAD.size))
        self.lower, self.upper, self.samples = HEAD.size, HEAD.size + a, HEAD.size + a + b
        self.size = self.samples + 4 * c

    def _bits(self, base: int, first: int, last: int) -> np.ndarray:
        """Bits first..last-1 of a section."""
        held = np.frombuffer(self.read(base + first // 8, (last + 7) // 8 - first // 8), np.uint8)
        return np.unpackbits(held, bitorder="little")[first % 8 : first % 8 + last - first]

    def select(self, i: int, words: int = 16) -> int:
        """Position of one number i in the upper bits: a sample, then popcounts of a few words at a time."""
        (start,) = struct.unpack("<I", self.read(self.samples + 4 * (i // SAMPLE), 4))
        left, word = i % SAMPLE, start // 64
        skip = start % 64
        while True:
            held = self.read(self.upper + 8 * word, min(8 * words, self.samples - self.upper - 8 * word))
            for at in range(0, len(held), 8):
                bits = int.from_bytes(held[at : at + 8], "little") >> skip << skip
                skip = 0
                ones = bits.bit_count()
                if ones > left:
                    for _ in range(left):
                        bits &= bits - 1
                    return (word + at // 8) * 64 + (bits & -bits).bit_length() - 1
                left -= ones
            word += words

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i, i + 1)[0])

    def block(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1: two selects, then a scan of the upper bits between them."""
        if first >= last:
            return np.zeros(0, np.int64)
        start, end = self.select(first), self.select(last - 1) + 1
        high = np.flatnonzero(self._bits(self.upper, start, end)) + start - np.arange(first, last)
        if not self.low_bits:
            return high
        low = self._bits(self.lower, first * self.low_bits, last * self.low_bits).reshape(-1, self.low_bits)
        return high << self.low_bits | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
