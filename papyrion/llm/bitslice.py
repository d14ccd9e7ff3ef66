"""Bit-sliced Hamming comparison of 64-bit codes, and union of links inside a block.

Codes of a block are stored as 64 bit planes: word w of plane b holds bit b of codes
64w..64w+63.  For a query code the 64 distances of a word are counted at once: the planes of a
step go through a tree of carry-save adders, three words of one weight into one of that weight
and one of the next, until each digit of the bitwise counters is a single word again.
(query, word) blocks whose lanes all exceed the radius are abandoned after each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(codes: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of uint64 codes, padded with zeros."""
    words = -(-len(codes) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(codes)] = codes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64))


def _lanes(low: np.ndarray, high: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Masks of the lanes of ``word`` whose position is in [low, high)."""
    a = np.clip(low - word * 64, 0, 64)
    b = np.clip(high - word * 64, 0, 64)

    def below(n: np.ndarray) -> np.ndarray:
        return np.where(n >= 64, ONES, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))

    return below(b) & ~below(a)


def near(codes: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, tile: int = 1 << 16, step: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (i, j) index arrays of all pairs with low[i] <= j < high[i] and distance <= radius.

    ``tile`` bounds the (query, word) blocks that are worked on at once.
    """
    sliced = planes(codes)
    first, last = low // 64, np.where(high > low, (high - 1) // 64 + 1, low // 64)
    spans = np.maximum(last - first, 0)
    rows = np.repeat(np.arange(len(codes)), spans)
    words = np.arange(len(rows)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(first, spans)
    digits = max(1, int(radius).bit_length())
    for at in range(0, len(rows), tile):
        q, w = rows[at : at + tile], words[at : at + tile]
        alive = _lanes(low[q], high[q], w)
        own = codes[q]
        count = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        over = ~alive
        for b in range(0, 64, step):
            differ = [sliced[k, w] ^ (np.uint64(0) - ((own >> np.uint64(k)) & np.uint64(1))) for k in range(b, min(b + step, 64))]
            over |= add_planes(count, differ)
            if b + step < 64:
                over |= _exceeds(count, radius)
                left = np.flatnonzero(over != ONES)
                if len(left) < 0.75 * len(q):
                    q, w, own, over = q[left], w[left], own[left], over[left]
                    count = [c[left] for c in count]
                if not len(q):
                    break
        if not len(q):
            continue
        hit = ~(over | _exceeds(count, radius))
        some = np.flatnonzero(hit)
        if not len(some):
            continue
        bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, lane = np.nonzero(bits)
        yield q[some][r], w[some][r] * 64 + lane


def add_planes(count: list[np.ndarray], added: list[np.ndarray]) -> np.ndarray:
    """Add planes of weight one to the counters (digit k has weight 2**k) in place; returns the lanes that overflow."""
    over = np.zeros_like(count[0])
    for k in range(len(count)):
        same, carried = [count[k], *added], []
        while len(same) > 2:  # full adders: three words of this weight
            a, b, c = same.pop(), same.pop(), same.pop()
            half = a ^ b
            same.append(half ^ c)
            carried.append((a & b) | (half & c))
        if len(same) == 2:
            carried.append(same[0] & same[1])
            same = [same[0] ^ same[1]]
        count[k], added = same[0], carried
    for plane in added:
        over |= plane
    return over


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], ONES)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked positions in place; a label is the smallest position of its class."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        least = np.minimum(x, y)
        np.minimum.at(labels, x, least)
        np.minimum.at(labels, y, least)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
