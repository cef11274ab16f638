"""FM-index over integer texts: suffix array, wavelet matrix, backward search, sampled locate.

All searches are vectorised over patterns: one rank step moves every pattern's interval.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol must be the unique smallest."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over small integers, one bit plane a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            plane = (seq >> bit) & 1
            self.ones.append(np.append(0, np.cumsum(plane)).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[plane == 0], seq[plane == 1]))

    def route(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = np.where((symbol >> bit) & 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their place in the sorted last level)."""
        symbol = np.zeros(len(at), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            one = self.ones[level][at + 1] - ones
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of ``text`` (integers >= 1; a 0 is added at the end)."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        top = int(text.max())
        self.top = top
        self.n = len(text)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        self.wavelet = WaveletMatrix(bwt, top)
        symbols = np.arange(top + 1)
        self.base = self.wavelet.route(symbols, np.zeros(top + 1, np.int64))
        self.marked = sa % sample == 0
        self.order = np.cumsum(self.marked) - 1
        self.places = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of equal-length patterns; empty where one does not occur."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = (patterns <= self.top).all(axis=1)
        hi[~alive] = 0
        live = np.flatnonzero(alive)
        for j in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, j]
            start = self.first[c] - self.base[c]
            lo[live] = start + self.wavelet.route(c, lo[live])
            hi[live] = start + self.wavelet.route(c, hi[live])
            gone = hi[live] <= lo[live]
            hi[live[gone]] = lo[live[gone]]
            live = live[~gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.marked[at]
            out[todo[known]] = self.places[self.order[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            symbol, routed = self.wavelet.access(at)
            at = self.first[symbol] + routed - self.base[symbol]
            steps += 1
        return out
