"""An R-tree over count vectors, and the join of its leaves by an upper bound of set overlap.

A set's point holds how many of its hashes fall into each of a number of groups. Two sets share at most the sum over groups of
the smaller count, and two boxes at most the sum of the smaller upper corners. The join descends pairs of nodes whose bound
reaches the overlap that the smallest sets in them would need, and whose sizes can be in proportion. Nodes all of whose
members are known to be connected needn't meet themselves or each other; what is found on the way counts at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from groundspark.llm.shingles import need

#: Groups of hashes, at least and at most; large sets need more, or all of their bounds are alike. Hashes in a group, on average.
LEAST_GROUPS, MOST_GROUPS, IN_GROUP = 256, 4_096, 8
FANOUT = 16
#: A count as large as this may stand for a larger one.
TOP = 255
#: Pairs of nodes whose bounds are taken at once, by the cells of their points.
AT_ONCE = 1 << 21


def point(own: np.ndarray, most: int | None = None) -> np.ndarray:
    """The count vector of a set of hashes; its groups are as many as the largest of several sets needs, if that is given."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and groups * IN_GROUP < (len(own) if most is None else most):
        groups *= 2
    at = (own >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), TOP).astype(np.uint8)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups, each of which is several of its own."""
    if len(counts) == groups:
        return counts
    return np.minimum(counts.reshape(groups, -1).sum(1, dtype=np.int64), TOP).astype(np.uint8)


def points(sets: list[np.ndarray]) -> np.ndarray:
    """The count vectors of several sets over the same groups, as rows."""
    most = max(map(len, sets), default=0)
    return np.stack([point(own, most) for own in sets])


def may_share(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether sets of these points, row by row, can have at least so many hashes in common."""
    both = np.minimum(x, y)
    return (both.sum(1, dtype=np.int32) >= least) | (both == TOP).any(1)


def tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order that puts like points side by side: by size, then by the most varied coordinates in slabs."""
    n = len(points)
    order = np.argsort(sizes, kind="stable")
    if n <= FANOUT:
        return order
    varied = np.argsort(-points.var(0), kind="stable")[:2]
    slab = max(FANOUT, int(np.ceil(n ** (2 / 3))))
    out = []
    for a in range(0, n, slab):
        part = order[a : a + slab]
        part = part[np.argsort(points[part, varied[0]], kind="stable")]
        strip = max(FANOUT, int(np.ceil(len(part) ** 0.5)))
        for b in range(0, len(part), strip):
            row = part[b : b + strip]
            out.append(row[np.argsort(points[row, varied[1]], kind="stable")])
    return np.concatenate(out)


class RTree:
    """Levels from single points (0) to the root; each node covers FANOUT nodes of the level below. ``known``: components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, known: np.ndarray):
        n = len(points)
        place = np.empty(n, np.int64)
        place[tiled(points, sizes)] = np.arange(n)
        # Members of a component come together, so that nodes are passed over whole.
        names, label = np.unique(known, return_inverse=True)
        first = np.full(len(names), n, np.int64)
        np.minimum.at(first, label, place)
        self.order = np.lexsort((place, first[label]))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.label = label[self.order]
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > 1:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
        self._settle()

    def _settle(self) -> None:
        """The smallest and largest component in each node."""
        first = last = self.label
        self.ends = [(first, last)]
        for _ in self.levels[1:]:
            at = np.arange(0, len(first), FANOUT)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.ends.append((first, last))
        self.stale = False

    def connected(self, a, b):
        return self.label[self.place[a]] == self.label[self.place[b]]

    def connect(self, a: int, b: int) -> None:
        x, y = self.label[self.place[a]], self.label[self.place[b]]
        self.label[self.label == max(x, y)] = min(x, y)
        self.stale = True

    def tied(self, a: np.ndarray, b: np.ndarray, close: Callable[[int, int], bool], tile: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Connects pairs that are close and not connected yet; of different tiles only, if given. Returns those that did so."""
        if tile is not None:
            across = tile[a] != tile[b]
            a, b = a[across], b[across]
        out = []
        while len(a):
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if close(x, y):
                    out.append((x, y))
                    self.connect(x, y)
                    a, b = a[k + 1 :], b[k + 1 :]
                    left = ~self.connected(a, b)
                    a, b = a[left], b[left]
                    break
            else:
                break
        return out

    def _open(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes that don't lie in one component by now."""
        if self.stale:
            self._settle()
        first, last = self.ends[level]
        return ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))

    def join(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of distinct points, as arrays of their numbers, that pass all bounds and aren't known to be connected.

        Nodes meet themselves before others, so what is close is connected early.
        """
        if len(self.order) < 2:
            return
        at_once = max(64, AT_ONCE // self.levels[0][0].shape[1])
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        kids = np.arange(FANOUT)
        while stack:
            level, left, right = stack.pop()
            still = self._open(level, left, right)
            left, right = left[still], right[still]
            if not len(left):
                continue
            if level == 0:
                yield self.order[left], self.order[right]
                continue
            # All pairs of children; of a node with itself only one half.
            top, low, high = self.levels[level - 1]
            n = len(top)
            a = (left[:, None, None] * FANOUT + kids[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
            b = (right[:, None, None] * FANOUT + kids[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
            a, b = a.ravel(), b.ravel()
            fits = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            a, b = a[fits], b[fits]
            fits = self._open(level - 1, a, b) & (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
            a, b = a[fits], b[fits]
            passed = [may_share(top[a[k : k + at_once]], top[b[k : k + at_once]], need(low[a[k : k + at_once]], low[b[k : k + at_once]])) for k in range(0, len(a), at_once)]
            ok = np.concatenate(passed) if passed else np.zeros(0, bool)
            own = a == b
            width = FANOUT * 4 if level > 1 else at_once
            for some in (np.flatnonzero(ok & ~own), np.flatnonzero(ok & own)):
                for k in reversed(range(0, len(some), width)):
                    stack.append((level - 1, a[some[k : k + width]], b[some[k : k + width]]))
