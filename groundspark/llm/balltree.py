"""Ball trees in numpy, over the rows of one task or a bounded sample, and the inner products that two nodes can have."""

from __future__ import annotations

import numpy as np


class BallTree:
    """Nodes as flat arrays; left is -1 in a leaf. A node's rows are order[start:end]. They are divided along the component of
    the largest spread at its mean, which parts clusters, or in halves where that would leave one side with few, so that equal
    vectors are divided as well; in a leaf ids rise. ``labels``: the least and the largest of each node."""

    def __init__(self, vectors: np.ndarray, leaf: int, labels: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.order = np.arange(len(vectors))
        start, end, left, right, centre, radius, kinds = [0], [len(vectors)], [-1], [-1], [], [], []
        k = 0
        while k < len(start):
            a, b = start[k], end[k]
            own = vectors[self.order[a:b]]
            middle = own.mean(0) if b > a else np.zeros(vectors.shape[1])
            centre.append(middle)
            radius.append(float(np.sqrt(((own - middle) ** 2).sum(1).max())) if b > a else 0.0)
            seen = labels[self.order[a:b]] if labels is not None and b > a else np.zeros(1, np.int64)
            kinds.append((seen.min(), seen.max()))
            if b - a > leaf:
                by = own[:, np.argmax(own.var(0))]
                self.order[a:b] = self.order[a:b][np.argsort(by, kind="stable")]
                low = int((by < by.mean()).sum())
                cut = a + low if min(low, b - a - low) * 16 >= b - a else (a + b) // 2
                left[k], right[k] = len(start), len(start) + 1
                start += [a, cut]
                end += [cut, b]
                left += [-1, -1]
                right += [-1, -1]
            elif ids is not None:
                self.order[a:b] = self.order[a:b][np.argsort(ids[self.order[a:b]], kind="stable")]
            k += 1
        self.start, self.end, self.left, self.right = (np.array(x, np.int64) for x in (start, end, left, right))
        self.centre, self.radius, self.labels = np.array(centre), np.array(radius), np.array(kinds)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf that each vector comes to, by the nearer centre at each level."""
        at = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(self.left[at] >= 0)
            if not len(go):
                return at
            left, right = self.left[at[go]], self.right[at[go]]
            away = lambda nodes: ((x[go] - self.centre[nodes]) ** 2).sum(1)  # noqa: B023, E731
            at[go] = np.where(away(left) <= away(right), left, right)


def interval(mine: BallTree, a: int, theirs: BallTree, nodes: np.ndarray, near: float | None = None, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds for the inner products of rows in node ``a`` with rows in each of ``nodes``. ``near``, ``far``: radii, if not the trees' own."""
    r, s = mine.radius[a] if near is None else near, theirs.radius[nodes] if far is None else far
    middle = theirs.centre[nodes] @ mine.centre[a]
    spread = mine.norm[a] * s + theirs.norm[nodes] * r + r * s + 1e-9 * (mine.norm[a] + r) * (theirs.norm[nodes] + s) + 1e-6
    return middle - spread, middle + spread
