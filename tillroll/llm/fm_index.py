"""FM-index over word numbers: a suffix array, its Burrows-Wheeler transform in a wavelet matrix, sampled positions.

The text is an array of symbols: 1 to ``sigma`` are words, 0 ends a run of words (also the last one). Every end counts as
a symbol of its own, smaller than all words, so that nothing is found across it. An index is built, searched and dropped
within one task; all methods work on whole arrays of queries at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling over those that are not yet told apart."""
    n = len(symbols)
    ends = symbols == 0
    code = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    width = max(1, int(code.max()).bit_length()) if n else 1
    known = max(1, 62 // width)
    # the first few symbols packed into one number
    packed = code.copy()
    for i in range(1, known):
        following = np.zeros(n, np.int64)
        following[: max(n - i, 0)] = code[i:]
        packed = (packed << width) | following
    sa = np.argsort(packed, kind="stable")
    ordered = packed[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    slots = np.arange(n)
    first = np.maximum.accumulate(np.where(new, slots, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    slots = slots[~(new & np.r_[new[1:], True])]
    while len(slots):
        position, group = sa[slots], first[slots]
        # runs end in symbols of their own, so a suffix that is not told apart yet goes on
        second = rank[np.minimum(position + known, n - 1)]
        order = np.lexsort((second, group))
        position, second = position[order], second[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        begin = np.maximum.accumulate(np.where(new, slots, 0))
        sa[slots] = position
        first[slots] = begin
        rank[position] = begin
        slots = slots[~(new & np.r_[new[1:], True])]
        known *= 2
    return sa


class _Bits:
    """A bit vector with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        words = len(bits) // 64 + 1
        raw = np.zeros(words * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.zeros(words, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Counts and reads symbols of an array, one bit vector for every bit of a symbol."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[int, int, _Bits]] = []
        for b in reversed(range(max(1, int(sigma).bit_length()))):
            bits = (values >> b & 1).astype(bool)
            zeros = len(values) - int(bits.sum())
            self.levels.append((b, zeros, _Bits(bits)))
            values = np.concatenate([values[~bits], values[bits]])
        self.start = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, zeros, bits in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def count(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before i."""
        return self._descend(symbol, i) - self.start[symbol]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol = np.zeros(len(i), np.int64)
        for _, zeros, bits in self.levels:
            bit = bits.at(i).astype(np.int64)
            ones = bits.ones(i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i - self.start[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        """``symbols`` ends with 0. Every ``sample``-th position, and every start of a run, can be read off directly."""
        self.n = len(symbols)
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        before[sa == 0] = 0
        self.bwt = WaveletMatrix(before, sigma)
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.smaller = np.cumsum(counts) - counts
        marked = (sa % sample == 0) | (before == 0)
        self.marked = _Bits(marked)
        self.positions = sa[marked]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with ``symbol`` and go on with those of rows low to high."""
        both = self.bwt.count(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.smaller[symbol]
        return start + both[: len(low)], start + both[len(low) :]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (low to high) of every phrase; the phrases are the rows of a matrix of words."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n)
        for column in reversed(range(phrases.shape[1])):
            open_ = np.flatnonzero(low < high)
            low[open_], high[open_] = self.extend(phrases[open_, column], low[open_], high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text: steps back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, which, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(which):
            known = self.marked.at(at).astype(bool)
            out[which[known]] = self.positions[self.marked.ones(at[known])] + steps
            at, which = at[~known], which[~known]
            symbol, occurrence = self.bwt.read(at)
            at = self.smaller[symbol] + occurrence
            steps += 1
        return out
