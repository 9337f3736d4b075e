"""Hierarchical index of fingerprints in Gray order, inside one task.

Fingerprints sorted by Gray rank differ little from their neighbours. A node stands for a run of them and keeps the bits
on which the whole run agrees (mask, pattern). Two nodes whose patterns differ in more bits than allowed, counted on the
bits both have fixed, cannot hold a link, so the pair is dropped with everything below it.
"""

from __future__ import annotations

import numpy as np

FANOUT = 4
#: Pairs of nodes that one step looks at; more wait their turn, so memory does not depend on the data.
STEP = 1 << 16


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_value(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


class GrayIndex:
    """Levels of (pattern, mask, group), leaves first; a node never spans two groups."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        full = np.full(len(values), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(values, full, groups)]
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)]
        ones, anyone = values, values
        while len(values) > 1:
            heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            place = np.arange(len(values)) - np.repeat(heads, np.diff(np.r_[heads, len(values)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            if len(starts) == len(values):
                break
            ones, anyone = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(anyone, starts)
            mask = ~(ones ^ anyone)
            values, groups = ones & mask, groups[starts]
            self.levels.append((values, mask, groups))
            self.children.append(np.r_[starts, len(place)])

    def links(self, other: GrayIndex, distance: int):
        """Yield blocks of leaf pairs (i here, j there) of one group that differ in at most so many bits.

        Both indexes must have as many levels; ``aligned`` sees to it. With itself, pairs come once, i < j.
        """
        top = len(self.levels) - 1
        mine, theirs = self.levels[top][2], other.levels[top][2]
        first = np.searchsorted(theirs, mine, "left")
        count = np.searchsorted(theirs, mine, "right") - first
        i = np.repeat(np.arange(len(mine)), count)
        j = np.repeat(first, count) + _counting(count)
        waiting = [(top, i, j)]
        while waiting:
            level, i, j = waiting.pop()
            if len(i) > STEP:
                waiting.append((level, i[STEP:], j[STEP:]))
                i, j = i[:STEP], j[:STEP]
            if self is other:
                ahead = i < j if level == 0 else i <= j
                i, j = i[ahead], j[ahead]
            (a, a_mask, _), (b, b_mask, _) = self.levels[level], other.levels[level]
            near = np.bitwise_count((a[i] ^ b[j]) & a_mask[i] & b_mask[j]) <= distance
            i, j = i[near], j[near]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            mine, theirs = self.children[level], other.children[level]
            n_mine, n_theirs = mine[i + 1] - mine[i], theirs[j + 1] - theirs[j]
            count = n_mine * n_theirs
            step, wide = _counting(count), np.repeat(n_theirs, count)
            waiting.append((level - 1, np.repeat(mine[i], count) + step // wide, np.repeat(theirs[j], count) + step % wide))

    def aligned(self, height: int) -> GrayIndex:
        """The same index with single-child levels on top, up to a height."""
        while len(self.levels) < height:
            n = len(self.levels[-1][0])
            self.levels.append(self.levels[-1])
            self.children.append(np.arange(n + 1))
        return self


def _counting(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Forest:
    """Smallest-member labels of n items under links that come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
        self.label = label
