"""An FM-index over a sequence of word numbers, searched for many phrases at once.

Symbol 0 separates runs of words and is never searched. Ranks come from a
wavelet matrix over the Burrows-Wheeler transform; positions come from sampled
suffix positions, reached by walking backwards.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; every separator sorts apart, so runs bound the rounds."""
    n = len(seq)
    gaps = seq == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, seq + int(gaps.sum())).astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        keys = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]]) if n else 0
        if n == 0 or new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """``seq``: word numbers from 1 to ``symbols``, 0 between runs and at the end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.n = len(seq)
        order = suffix_order(seq)
        bwt = seq[order - 1]
        self.levels = max(1, int(symbols).bit_length())
        self.matrix: list[Bits] = []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            ones = (row >> level & 1).astype(bool)
            self.matrix.append(Bits(ones))
            row = np.concatenate([row[~ones], row[ones]])
        self.starts = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        every = np.arange(symbols + 1)
        self.floor = self._descend(every, np.zeros(symbols + 1, np.int64))
        kept = (order % SAMPLED == 0) | (seq[order - 1] == 0)
        self.sampled, self.samples = Bits(kept), order[kept]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.matrix):
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        return self._descend(symbol, at) - self.floor[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one word earlier."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for bits in self.matrix:
            one, ones = bits.get(at), bits.ones(at)
            symbol = symbol << 1 | one
            at = np.where(one, bits.zeros + ones, at - ones)
        return self.starts[symbol] + at - self.floor[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases given as rows of word numbers, filled up on the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        hi[lengths == 0] = 0
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (hi[live] > lo[live])]
            symbol = phrases[live, lengths[live] - 1 - step]
            lo[live] = self.starts[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.starts[symbol] + self.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions in the sequence of these rows' suffixes."""
        out, steps = np.zeros(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            found = self.sampled.get(rows)
            out[open_[found]] = self.samples[self.sampled.ones(rows[found])] + steps
            open_, rows = open_[~found], self.back(rows[~found])
            steps += 1
        return out
