"""Gradient-boosted trees for two classes on histograms, in numpy. For bounded samples on the driver; scoring is vectorised."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Flat arrays by node; feature -1 marks a leaf. A row goes left if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return self.value[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))


class Boosted(NamedTuple):
    base: float
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.score(x)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each column: midpoints between values at its quantiles."""
    out = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        mids = (values[1:] + values[:-1]) / 2
        out.append(mids if len(mids) < bins else np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, columns: np.ndarray, depth: int, least: float, shrink: float) -> Tree:
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    lam = 1.0
    stack = [(0, np.arange(len(grad)), 0)]
    while stack:
        node, rows, level = stack.pop()
        g, h = grad[rows], hess[rows]
        gs, hs = g.sum(), h.sum()
        value[node] = float(-shrink * gs / (hs + lam))
        if level == depth or len(rows) < 2:
            continue
        best = (1e-6, -1, 0)
        for f in columns:
            n = len(edges[f]) + 1
            if n < 2:
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g, n))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h, n))[:-1]
            gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
            gain[(hl < least) | (hs - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
        _, f, k = best
        if f < 0:
            continue
        feature[node], threshold[node] = f, float(edges[f][k])
        goes = binned[rows, f] <= k
        for side, part in ((left, rows[goes]), (right, rows[~goes])):
            side[node] = len(feature)
            for column, fill in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                column.append(fill)
            stack.append((side[node], part, level + 1))
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, share: float = 0.7, column_share: float = 0.7, least: float = 1.0, seed: int = 7) -> Boosted:
    """Logistic loss; each tree sees a seeded share of the rows and columns."""
    rng = np.random.default_rng(seed)
    edges = edges_of(x, bins)
    # searchsorted from the left: a value equal to an edge goes left, as in scoring
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, int)
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base, trees = float(np.log(p / (1 - p))), []
    z = np.full(len(y), base)
    for _ in range(rounds):
        pr = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < share)
        columns = np.flatnonzero(rng.random(x.shape[1]) < column_share)
        t = grow(binned[rows], edges, (pr - y)[rows], (pr * (1 - pr))[rows], columns, depth, least, rate)
        trees.append(t)
        z += t.score(x)
    return Boosted(base, trees)
