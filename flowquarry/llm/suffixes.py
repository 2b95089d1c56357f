"""Enhanced suffix arrays in numpy: order, common extensions to both sides, and the intervals of common prefixes.

Symbols are whole numbers. Every text in the array must end with a symbol that
occurs nowhere else, so that no common prefix runs over the end of a text.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """Suffix array by prefix doubling; only suffixes still tied are sorted again.

    ``order`` lists the suffixes, ``place`` is its inverse. The ranks of every
    round stay: two suffixes have equal ranks of width h exactly if they share
    their first h symbols, which answers common extensions by binary descent.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols, n = symbols, len(symbols)
        order = np.argsort(symbols, kind="stable")
        active = np.arange(n)
        rank = np.empty(n, np.int64)
        active, moved, starts = self._split(symbols[order], active)
        rank[order] = starts
        self.levels = [(1, rank.astype(np.int32 if n < 2**31 else np.int64))]
        width = 1
        while len(active):
            at = order[active]
            key = rank[at] * n + rank[at + width]
            by = np.argsort(key)
            at = order[active] = at[by]
            active, moved, starts = self._split(key[by], active)
            rank[at] = starts
            width *= 2
            self.levels.append((width, rank.astype(self.levels[0][1].dtype)))
        self.order, self.place = order, rank

    @staticmethod
    def _split(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys at places of the array: places still tied, where groups begin, and each one's first place."""
        begins = np.append(True, key[1:] != key[:-1])[: len(key)]
        starts = places[np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))]
        tied = ~(begins & np.append(begins[1:], True)[: len(key)])
        return places[tied], begins, starts

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes a and b (a differs from b everywhere)."""
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            length += width * (rank[a + length] == rank[b + length])
        return length

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols right before a and b agree (a differs from b everywhere)."""
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            x, y = a - length - width, b - length - width
            inside = (x >= 0) & (y >= 0)
            length += width * (inside & (rank[x * inside] == rank[y * inside]))
        return length

    def common(self) -> np.ndarray:
        """Length of the common prefix of each suffix in order with the one before it; 0 for the first."""
        out = np.zeros(len(self.order), np.int64)
        first = self.symbols[self.order]
        at = np.flatnonzero(first[1:] == first[:-1]) + 1
        out[at] = self.ahead(self.order[at - 1], self.order[at])
        return out


def _nearest(values: np.ndarray, at: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place in ``at`` the nearest place before (step -1) or after (step 1) with a lower (or equal) value.

    Pointers jump over what their targets have jumped over. The values at both
    ends must be lower than any at ``at``.
    """
    to = np.arange(len(values)) + step
    todo = at
    while len(todo):
        there = values[to[todo]]
        todo = todo[there >= values[todo] if strict else there > values[todo]]
        to[todo] = to[to[todo]]
    return to[at]


def intervals(common: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The children of all intervals of suffixes that share ``least`` symbols or more, without building a tree.

    Returns arrays with an entry per child: depth, first and last place of its
    interval, first and last place of the child. The children of an interval
    are the ranges between the places where the common prefix is just its depth.
    """
    n = len(common)
    values = np.concatenate((common, [-1]))
    if n:
        values[0] = -1
    at = np.flatnonzero(values >= max(least, 1))
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    depth = values[at]
    # A lower or equal value before is where the child on the left begins; strictly lower ones bound the interval.
    begin = _nearest(values, at, -1, strict=False)
    first = _nearest(values, at, -1, strict=True)
    after = _nearest(values, at, 1, strict=False)
    last = _nearest(values, at, 1, strict=True) - 1
    final = values[after] < depth
    return (
        np.concatenate((depth, depth[final])), np.concatenate((first, first[final])), np.concatenate((last, last[final])),
        np.concatenate((begin, at[final])), np.concatenate((at - 1, after[final] - 1)),
    )


def smaller_children(first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for every child of :func:`intervals` but one largest of each interval."""
    size = end - begin
    by = np.lexsort((size, last, first))
    largest = np.append((first[by][1:] != first[by][:-1]) | (last[by][1:] != last[by][:-1]), True)[: len(by)]
    out = np.empty(len(by), bool)
    out[by] = ~largest
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of many ranges one after the other, and the range each belongs to."""
    owner = np.repeat(np.arange(len(begin)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner
