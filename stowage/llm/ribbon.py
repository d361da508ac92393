"""Ribbon filters in numpy: static key -> fingerprint maps from banded linear systems.

A sealed batch of keys becomes many small independent systems (buckets) solved
together. Each key has a start slot, a 64-bit coefficient row (lowest bit set)
and an r-bit fingerprint; the solution table S satisfies, for every key,
XOR of S[start + j] over the set bits j = fingerprint. Elimination runs in
vectorised rounds over all pending keys; back substitution runs over the slots
of all buckets at once. A present key always matches; an absent one matches
with probability 2**-r. Keys whose system has no solution are kept exactly.
"""

from __future__ import annotations

import numpy as np

BAND = 64
BUCKET_KEYS = 512
_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ _U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def _trailing_zeros(x: np.ndarray) -> np.ndarray:
    low = x & (~x + _U(1))
    return np.bitwise_count(low - _U(1)).astype(np.int64)


class Ribbon:
    """A filter over 128-bit keys given as two uint64 arrays."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, bits: int = 32, slack: float = 1.12):
        n = len(hi)
        self.keys = n
        self.bits = bits
        self.fp_mask = _U((1 << bits) - 1)
        self.buckets = max(1, n // BUCKET_KEYS)
        bucket = self._bucket(hi, lo)
        fullest = int(np.bincount(bucket, minlength=self.buckets).max()) if n else 1
        self.starts = max(8, int(fullest * slack) + 8)
        self.width = self.starts + BAND
        slot, coeff, value = self._rows(hi, lo, bucket)
        c = np.zeros(self.buckets * self.width, _U)
        b = np.zeros(self.buckets * self.width, _U)
        owner = np.empty(len(c), np.int64)
        failed = []
        at = np.arange(n)
        while len(at):
            s = slot[at]
            free = c[s] == 0
            owner[s[free]] = at[free]
            won = free & (owner[s] == at)
            c[s[won]] = coeff[at[won]]
            b[s[won]] = value[at[won]]
            at = at[~won]
            s = slot[at]
            left = coeff[at] ^ c[s]
            value[at] ^= b[s]
            gone = left == 0
            failed.append(at[gone & (value[at] != 0)])
            at, left = at[~gone], left[~gone]
            shift = _trailing_zeros(left)
            slot[at] += shift
            coeff[at] = left >> shift.astype(_U)
        self.table = self._solve(c, b)
        lost = np.concatenate(failed) if failed else np.empty(0, np.int64)
        self.exact = set(zip(hi[lost].tolist(), lo[lost].tolist()))

    def _bucket(self, hi, lo):
        return ((mix(hi ^ lo, 3) >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)

    def _rows(self, hi, lo, bucket):
        start = (mix(hi + lo, 5) >> _U(32)) * _U(self.starts) >> _U(32)
        coeff = mix(hi ^ (lo << _U(1)), 7) | _U(1)
        value = mix(lo ^ (hi >> _U(1)), 11) & self.fp_mask
        return bucket * self.width + start.astype(np.int64), coeff, value

    def _solve(self, c, b):
        kind = np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32 if self.bits <= 32 else _U
        rows = np.unpackbits(c.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little").reshape(self.buckets, self.width, BAND).astype(bool)
        value = b.reshape(self.buckets, self.width).astype(kind)
        table = np.zeros((self.buckets, self.width + BAND), kind)
        for i in range(self.width - 1, -1, -1):
            near = np.where(rows[:, i, 1:], table[:, i + 1 : i + BAND], kind(0))
            table[:, i] = value[:, i] ^ np.bitwise_xor.reduce(near, axis=1)
        # free variables stay zero: an unset row must not keep a value
        return table

    def dump(self) -> bytes:
        """The filter as bytes, for a sealed generation."""
        exact = np.array(sorted(self.exact), _U).reshape(-1, 2)
        head = np.array([self.keys, self.bits, self.buckets, self.starts, self.table.itemsize, len(exact)], "<i8")
        return head.tobytes() + exact.astype("<u8").tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Ribbon:
        out = cls.__new__(cls)
        keys, bits, buckets, starts, item, exact = np.frombuffer(data, "<i8", 6).tolist()
        out.keys, out.bits, out.buckets, out.starts = keys, bits, buckets, starts
        out.fp_mask, out.width = _U((1 << bits) - 1), starts + BAND
        out.exact = set(map(tuple, np.frombuffer(data, "<u8", 2 * exact, 48).reshape(-1, 2).tolist()))
        out.table = np.frombuffer(data, f"<u{item}", offset=48 + 16 * exact).reshape(buckets, out.width + BAND)
        return out

    @property
    def nbytes(self) -> int:
        return self.table.nbytes + 16 * len(self.exact)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True for every key of the filter and for 2**-bits of all others."""
        out = np.zeros(len(hi), bool)
        for i in range(0, len(hi), 16_384):
            h, l = hi[i : i + 16_384], lo[i : i + 16_384]
            bucket = self._bucket(h, l)
            slot, coeff, value = self._rows(h, l, bucket)
            slot = slot + bucket * BAND  # a table row is BAND slots longer than a system
            flat, acc = self.table.reshape(-1), np.zeros(len(h), self.table.dtype)
            for j in range(BAND):
                on = (coeff >> _U(j)) & _U(1)
                acc ^= flat[slot + j] * on.astype(self.table.dtype)
            out[i : i + 16_384] = acc.astype(_U) == value
        if self.exact:
            out |= np.fromiter(((a, b) in self.exact for a, b in zip(hi.tolist(), lo.tolist())), bool, len(hi))
        return out
