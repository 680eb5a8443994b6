"""Suffix arrays of integer strings, with common prefixes before and after any two places.

A string's last symbol must be unique in it; so must a symbol between parts that
mustn't share a substring. Level k of the prefix doubling names the substring of
2**k symbols at each place; two places' longest common extension is the sum of the
levels, from the largest down, on which they agree.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np


class Suffixes:
    """order: places by suffix; levels[k]: the name of the 2**k symbols from each place (the first place in order of those that agree)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n, self.order = n, np.argsort(symbols, kind="stable")
        key = symbols[self.order]
        fresh = np.r_[True, key[1:] != key[:-1]][:n]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels, h = [rank], 1
        active = np.flatnonzero(~(fresh & np.r_[fresh[1:], True][:n]))
        while active.size:
            here = self.order[active]
            key = rank[here].astype(np.int64) * n + rank[here + h]  # what isn't told apart yet ends before the last symbol
            by = np.argsort(key, kind="stable")
            key, here = key[by], here[by]
            self.order[active] = here
            fresh = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[here] = active[np.maximum.accumulate(np.where(fresh, np.arange(active.size), 0))]
            self.levels.append(rank)
            active = active[~(fresh & np.r_[fresh[1:], True])]
            h *= 2

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common prefix of the suffixes at a and at b (a != b)."""
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            common += (level[a + common] == level[b + common]).astype(np.int64) << k
        return common

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common suffix of what ends with place a and with place b (a != b; -1 is before the string)."""
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x, y = self.levels[k], a - common - (1 << k) + 1, b - common - (1 << k) + 1
            inside = (x >= 0) & (y >= 0)
            common += (inside & (level[np.where(inside, x, 0)] == level[np.where(inside, y, 0)])).astype(np.int64) << k
        return common

    @cached_property
    def lcp(self) -> np.ndarray:
        """Of each place in order, the common prefix with the one before it (0 for the first)."""
        return np.r_[0, self.after(self.order[:-1], self.order[1:])][: self.n]

    @cached_property
    def _least(self) -> list[np.ndarray]:
        """least[k][r]: the least of lcp[r : r + 2**k]."""
        least, h = [self.lcp], 1
        while 2 * h <= self.n:
            least.append(np.minimum(least[-1][:-h], least[-1][h:]))
            h *= 2
        return least

    def interval(self, places: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last rank of the suffixes that begin with the depth symbols at each place: the subtree below that locus of the suffix tree."""
        lo, hi = self.rank[places].astype(np.int64), self.rank[places].astype(np.int64)
        for k in range(len(self._least) - 1, -1, -1):
            least, h = self._least[k], 1 << k
            x = lo - h + 1  # lcp[x..lo] joins ranks x - 1 to lo
            inside = x >= 1
            lo = np.where(inside & (least[np.where(inside, x, 0)] >= depth), lo - h, lo)
            inside = hi + h < self.n
            hi = np.where(inside & (least[np.where(inside, hi + 1, 0)] >= depth), hi + h, hi)
        return lo, hi

    def previous(self) -> np.ndarray:
        """For each place, the longest prefix of its suffix that also begins at an earlier place (it may overlap)."""
        n, rank = self.n, self.rank.tolist()
        up, down = list(range(-1, n)), [*range(1, n + 1), n + 1]  # of rank r; entry n stands for none, at either end
        above, below = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # ranks of later places are gone
            r = rank[i]
            a, b = up[r], down[r]
            above[i], below[i] = a, b
            if a >= 0:
                down[a] = b
            if b < n:
                up[b] = a
        longest = np.zeros(n, np.int64)
        for near in (np.array(above, np.int64), np.array(below, np.int64)):
            some = np.flatnonzero((near >= 0) & (near < n))
            longest[some] = np.maximum(longest[some], self.after(some, self.order[near[some]]))
        return longest


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts[i] .. starts[i] + sizes[i] - 1, one range after another, and the i of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes), owner


def repeated_stretches(symbols: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Whether each position lies in a window of symbols that occurs twice or more in its text (or, by chance of a 64-bit hash, seems to)."""
    inside = np.zeros(len(symbols), bool)
    n = len(symbols) - window + 1
    if n < 2:
        return inside
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ symbols[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    _, which, counts = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[counts[which] > 1]
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges)[:-1] > 0


def joined_stretches(symbols: np.ndarray, doc: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols at the places inside as one string, with a symbol of its own after each stretch, and the place of each symbol in it, -1 for those."""
    fresh = np.r_[False, (np.diff(inside) != 1) | (np.diff(doc[inside]) != 0)]
    at = np.arange(len(inside)) + np.cumsum(fresh)
    string = np.arange(at[-1] + 2) + symbols.max() + 1
    string[at] = symbols[inside]
    origin = np.full(len(string), -1, np.int64)
    origin[at] = inside
    return np.unique(string, return_inverse=True)[1], origin
