"""Suffix arrays over word codes, the equality classes of dyadic blocks, and a wavelet tree over positions (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np


class DyadicSuffixes:
    """Suffixes of many texts at once, sorted by prefix doubling; the ranks of every round are kept.

    ``codes``: word codes of all texts one after another; ``ends``: where each text ends. Suffixes of
    different texts share nothing. ``ranks[k][i]`` is the same for two places of one text if and only
    if the same 2**k words stand there; as it is the first place of that class in the suffix array,
    it is where the array's interval of the block of 2**k words at i begins.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = len(codes)
        self.text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.end = np.asarray(ends, np.int64)[self.text] if n else np.empty(0, np.int64)
        key = self.text * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks, width = [rank], 1
        while not head.all():
            open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of classes with more than one
            at = self.order[open_]
            after = at + width
            second = np.where(after < self.end[at], rank[np.minimum(after, n - 1)], -1)
            own = rank[at].astype(np.int64)
            pair = own * (n + 1) + second + 1
            by = np.argsort(pair, kind="stable")
            self.order[open_], pair = at[by], pair[by]
            head[open_[1:]] |= pair[1:] != pair[:-1]
            rank = rank.copy()
            first = np.maximum.accumulate(np.where(head[open_], open_, 0))  # the first of a class is always open
            rank[self.order[open_]] = first
            self.ranks.append(rank)
            width *= 2

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array's interval of the blocks of 2**k words at ``at``."""
        rank = self.ranks[min(k, len(self.ranks) - 1)]
        left = rank[at].astype(np.int64)
        return left, left + np.bincount(rank, minlength=len(rank))[left]

    def same_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal; a and b differ."""
        n, out = len(self.order), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            inside = (x < n) & (y < n)
            equal = inside & (self.ranks[k][np.minimum(x, n - 1)] == self.ranks[k][np.minimum(y, n - 1)])
            out += equal * (1 << k)
        return out

    def same_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words just before a and just before b are equal; a and b differ."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            equal = (x >= 0) & (y >= 0) & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])
            out += equal * (1 << k)
        return out


class WaveletTree:
    """Over numbers from 0 to len - 1 in some order; each level keeps how many zero bits come before a place."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, (len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number >= ``least`` at the places [left, right); where there is none, ``n``."""
        smaller = self._smaller(left, right, least)
        out = np.full(len(left), self.n, np.int64)
        some = np.flatnonzero(smaller < right - left)
        out[some] = self._kth(left[some], right[some], smaller[some])
        return out

    def _smaller(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        count, above, every = np.zeros(len(left), np.int64), least >= self.n, right - left
        least = np.minimum(least, self.n - 1)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b, all_ = zeros[left].astype(np.int64), zeros[right].astype(np.int64), int(zeros[-1])
            one = ((least >> bit) & 1).astype(bool)
            count = np.where(one, count + b - a, count)
            left, right = np.where(one, all_ + left - a, a), np.where(one, all_ + right - b, b)
        return np.where(above, every, count)

    def _kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b, all_ = zeros[left].astype(np.int64), zeros[right].astype(np.int64), int(zeros[-1])
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out |= one.astype(np.int64) << bit
            left, right = np.where(one, all_ + left - a, a), np.where(one, all_ + right - b, b)
        return out
