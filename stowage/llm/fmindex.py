"""A full-text index in numpy: suffix order, Burrows-Wheeler transform, wavelet
matrix with rank support, sampled suffix positions.

All operations work on arrays of patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
_U = np.uint64


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``, whose last symbol must be its unique least one."""
    n = len(s)
    key = s.astype(np.int64)
    span = int(key.max()) + 2
    h = 1
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        new = np.r_[0, np.cumsum(k[1:] != k[:-1])]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        if h == 1 and span**3 < 1 << 62:  # three symbols at once to begin with
            nxt = np.zeros((3, n), np.int64)
            for i in range(3):
                nxt[i, : n - i] = s[i:].astype(np.int64) + 1
            key, h = (nxt[0] * span + nxt[1]) * span + nxt[2], 3
            continue
        after = np.zeros(n, np.int64)
        if h < n:
            after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position ``i`` (at most the length)."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(_U)) & _U(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((s >> bit) & 1).astype(bool)
            self.levels.append((bit, _Bits(b), int(len(s) - b.sum())))
            s = np.concatenate([s[~b], s[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol ``c`` before position ``i``."""
        low = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            r_low, r_i = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + r_low, low - r_low)
            i = np.where(one, zeros + r_i, i - r_i)
        return i - low

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at position ``i`` and its occurrences before."""
        low, c = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = bits.get(i)
            c |= one.astype(np.int64) << bit
            r_low, r_i = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + r_low, low - r_low)
            i = np.where(one, zeros + r_i, i - r_i)
        return c, i - low


class FMIndex:
    """Over symbols 0..sigma-1; symbol 0 must stand at the end and nowhere else."""

    def __init__(self, s: np.ndarray, sigma: int):
        order = suffix_order(s)
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))]
        self.last = WaveletMatrix(s[order - 1].astype(np.int64), sigma)
        marked = order % SAMPLE == 0
        self.marks, self.samples, self.n = _Bits(marked), order[marked], len(s)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the row interval [low, high) of each pattern (a row of symbols)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.first[c] + self.last.rank(c, low[live])
            high[live] = self.first[c] + self.last.rank(c, high[live])
            live = live[high[live] > low[live]]
        hit = high > low
        return np.where(hit, low, 0), np.where(hit, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled suffix."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, row = np.arange(len(rows)), rows.copy()
        while len(live):
            at = self.marks.get(row)
            done = live[at]
            out[done] = self.samples[self.marks.rank(row[at])] + steps[done]
            live, row = live[~at], row[~at]
            if len(live):
                c, r = self.last.get(row)
                row = self.first[c] + r
                steps[live] += 1
        return out
