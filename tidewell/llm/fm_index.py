"""An FM-index over integer symbols: suffix order, wavelet ranks, sampled suffix positions.

All steps work on whole arrays: backward search moves every pattern of one length at once, and locating
moves every open occurrence at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends as soon as all ranks differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        tail = np.zeros(n, np.int64)
        if step < n:
            tail[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Wavelet matrix: rank(symbol, i) and access(i), for arrays of arguments."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for depth, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            ones, zero = self.ones[depth], self.zeros[depth]
            i = np.where(one, zero + ones[i], i - ones[i])
            start = np.where(one, zero + ones[start], start - ones[start])
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for depth in range(self.levels):
            ones, zero = self.ones[depth], self.zeros[depth]
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zero + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index of ``text``, whose symbols are 1 or more; 0 is the terminator it adds."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_order(text)
        symbols = int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.symbols = symbols
        self.ranks = Wavelet(text[order - 1], symbols)
        marked = order % sample == 0
        self.marked = marked
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of patterns (one a row, equal lengths) that occur: their numbers and row ranges [low, high)."""
        alive = np.flatnonzero((patterns < self.symbols).all(axis=1))
        last = patterns[alive, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            there = low < high
            alive, low, high = alive[there], low[there], high[there]
            c = patterns[alive, j]
            low, high = self.first[c] + self.ranks.rank(c, low), self.first[c] + self.ranks.rank(c, high)
        there = low < high
        return alive[there], low[there], high[there]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            hit = self.marked[at]
            out[open_[hit]] = self.sampled[self.mark_rank[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            c = self.ranks.access(at)
            at = self.first[c] + self.ranks.rank(c, at)
            steps += 1
        return out
