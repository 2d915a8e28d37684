"""FM-index over integer symbols: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends is smaller than one that goes on."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        key = rank * (n + 2)
        key[: max(0, n - k)] += rank[k:]
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        s = key[order]
        new[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            return order
        k *= 2


class WaveletTree:
    """Levels of bits from the highest, each sorted stably by the bits above: rank and access in one step a bit."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []  # ones before each position
        for b in range(bits - 1, -1, -1):
            on = (x >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(on))).astype(np.int32))
            self.zeros.append(len(x) - int(self.ones[-1][-1]))
            x = np.concatenate((x[on == 0], x[on == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            on = ((symbol >> b) & 1).astype(bool)
            ones, z = self.ones[level], self.zeros[level]
            a, c = ones[lo], ones[hi]
            lo, hi = np.where(on, z + a, lo - a), np.where(on, z + c, hi - c)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            on = ones[at + 1] > ones[at]
            out = out * 2 + on
            at = np.where(on, self.zeros[level] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of symbols 1 ... ``top``; 0 may stand in the text and matches nothing that is searched for."""

    def __init__(self, x: np.ndarray, top: int, sample: int = 16):
        x = np.append(x.astype(np.int64) + 1, 0)  # 0 is now the end mark
        sa = suffix_order(x)
        self.n, self.sample = len(x), sample
        self.tree = WaveletTree(x[sa - 1], max(1, int(top + 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=top + 3))))
        kept = np.flatnonzero(sa % sample == 0)
        self.has = np.zeros(self.n, bool)
        self.has[kept] = True
        self.place = np.cumsum(self.has) - 1
        self.position = sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern; a pattern is a row of symbols, filled up on the left with 0."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            live = live[(lo[live] < hi[live]) & (patterns[live, col] > 0)]
            if not len(live):
                break
            c = patterns[live, col].astype(np.int64) + 1
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one."""
        rows, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            there = self.has[rows[live]]
            done = live[there]
            out[done] = self.position[self.place[rows[done]]] + steps[done]
            live = live[~there]
            if len(live):
                c = self.tree.access(rows[live])
                rows[live] = self.before[c] + self.tree.rank(c, rows[live])
                steps[live] += 1
        return out
