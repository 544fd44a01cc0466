"""An FM-index over a sequence of small integers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self._words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self._before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << shift) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Rank and access over integers below ``1 << levels``; the tree's nodes of
    one depth lie next to each other in one bit vector."""

    def __init__(self, values: np.ndarray, levels: int):
        self._levels = []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1 != 0
            self._levels.append((level, BitVector(bits), int(len(values) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])
        # Where each symbol's leaf begins after the last level.
        symbols = np.arange(1 << levels)
        self.leaf = np.searchsorted(self._order(values, levels), self._reverse(symbols, levels))

    @staticmethod
    def _reverse(values: np.ndarray, levels: int) -> np.ndarray:
        """Leaves stand in the order of their symbols' reversed bits."""
        out = np.zeros(len(values), np.int64)
        for level in range(levels):
            out = (out << 1) | ((values >> level) & 1)
        return out

    def _order(self, values: np.ndarray, levels: int) -> np.ndarray:
        return self._reverse(values, levels)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol stands before the position."""
        start = self.leaf[symbol]
        for level, bits, zeros in self._levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for level, bits, zeros in self._levels:
            bit, ones = bits.get(at), bits.rank(at)
            symbol |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.leaf[symbol]


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Backward search and location by sampled suffix positions.

    ``values`` are positive integers; 0 is the end mark."""

    def __init__(self, values: np.ndarray, sample: int = 8):
        text = np.concatenate([values.astype(np.int64), [0]])
        order = suffix_array(text)
        last = text[order - 1]
        top = int(text.max())
        self._size, self._top = len(text), top
        self._before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self._tree = WaveletTree(last, max(1, top.bit_length()))
        self._sampled = BitVector(order % sample == 0)
        self._positions = order[order % sample == 0]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row, its first ``length`` values) the range of
        suffixes that begin with it."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self._size, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            known = symbol <= self._top
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self._before[symbol] + self._tree.rank(symbol, low[live])
            high[live] = self._before[symbol] + self._tree.rank(symbol, high[live])
        return low, np.where(lengths > 0, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        out, left, row = np.empty(len(rows), np.int64), np.arange(len(rows)), rows
        steps = 0
        while len(left):
            here = self._sampled.get(row)
            out[left[here]] = self._positions[self._sampled.rank(row[here])] + steps
            left, row = left[~here], row[~here]
            symbol, before = self._tree.access(row)
            row = self._before[symbol] + before
            steps += 1
        return out
