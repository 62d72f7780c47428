"""A compressed FM-index: the Burrows-Wheeler transform of a text in a wavelet matrix, searched backwards.

All searches of a batch advance together, one symbol a step, so every step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols as bit planes, most significant first, with counts of ones at every 64th place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, n = bits, len(symbols)
        self.planes, self.zeros = [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            one = ((now >> b) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.planes.append((words, ones))
            self.zeros.append(n - int(ones[-1]))
            now = np.concatenate([now[~one], now[one]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place."""
        lo, hi = np.zeros(len(place), np.int64), place.astype(np.int64)
        for level, (words, ones) in enumerate(self.planes):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            for at in (lo, hi):
                word = at >> 6
                below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
                one = ones[word] + np.bitwise_count(words[word] & below)
                at[:] = np.where(bit, self.zeros[level] + one, at - one)
        return hi - lo


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` symbols that start there, by doubling; ties in any order."""
    rank, span = text.astype(np.int64), 1
    n = len(text)
    order = np.argsort(rank, kind="stable")
    while span < depth:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        span *= 2
    return order


class FMIndex:
    """Over a text of symbols from 1; 0 ends each of its parts. Patterns of up to `depth` symbols can be searched."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth + 1)
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.tree = WaveletMatrix(text[self.order - 1], bits)
        self.start = np.append(0, np.cumsum(np.bincount(text, minlength=(1 << bits))))

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol put in front."""
        first = self.start[symbol]
        return first + self.tree.rank(symbol, lo), first + self.tree.rank(symbol, hi)

    def matching(self, symbol: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed symbols, to `steps` at most: for each place, how many symbols from it on
        occur together in the index, and the interval of that match. symbol: (places, steps), 0 past the end."""
        places = len(symbol)
        reach, low, high = np.zeros(places, np.int64), np.zeros(places, np.int64), np.zeros(places, np.int64)
        for length in range(steps, 0, -1):  # the longest that still matches
            live = np.flatnonzero((reach == 0) & (symbol[:, length - 1] > 0))
            if not len(live):
                continue
            last = symbol[live, length - 1]
            lo, hi = self.start[last], self.start[last + 1]
            for k in range(length - 2, -1, -1):
                some = np.flatnonzero(hi > lo)
                a, b = self.extend(lo[some], hi[some], symbol[live[some], k])
                hi = lo.copy()
                lo[some], hi[some] = a, b
            found = hi > lo
            reach[live[found]], low[live[found]], high[live[found]] = length, lo[found], hi[found]
        return reach, low, high
