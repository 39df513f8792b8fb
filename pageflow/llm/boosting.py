"""Gradient-boosted trees for small training sets of discrete features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in breadth-first order: feature (-1 for a leaf), threshold, left child, value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        for _ in range(len(self.feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            f = feature[at[rows]]
            at[rows] = left[at[rows]] + (x[rows, f] > threshold[at[rows]])
        return np.array(self.value)[at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> Tree:
    tree = Tree()

    def add(rows: np.ndarray) -> int:
        tree.feature.append(-1)
        tree.threshold.append(0.0)
        tree.left.append(-1)
        tree.value.append(float(g[rows].sum() / (h[rows].sum() + l2)))
        return len(tree.feature) - 1

    level = [(add(np.arange(len(x))), np.arange(len(x)), 0)]
    while level:
        node, rows, d = level.pop(0)
        if d == depth or len(rows) < 2:
            continue
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values, inverse = np.unique(x[rows, f], return_inverse=True)
            if len(values) < 2:
                continue
            gl, hl = np.cumsum(np.bincount(inverse, g[rows]))[:-1], np.cumsum(np.bincount(inverse, h[rows]))[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((values[k] + values[k + 1]) / 2))
        if best[1] < 0:
            continue
        goes_right = x[rows, best[1]] > best[2]
        left = add(rows[~goes_right])
        right = add(rows[goes_right])
        tree.feature[node], tree.threshold[node], tree.left[node] = best[1], best[2], left
        level += [(left, rows[~goes_right], d + 1), (right, rows[goes_right], d + 1)]
    return tree


@dataclass
class Boosted:
    """A softmax of boosted trees over *classes*."""

    classes: int
    trees: list[list[Tree]]
    rate: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities, one row for each row of *x*."""
        f = np.zeros((len(x), self.classes))
        for each in self.trees:
            for c, tree in enumerate(each):
                f[:, c] += self.rate * tree.predict(x)
        f -= f.max(axis=1, keepdims=True)
        return f - np.log(np.exp(f).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.4, l2: float = 1.0) -> Boosted:
    """Boosted trees by second-order steps; equal rows are weighed together, so the cost follows the distinct rows."""
    rows, inverse = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    weight = np.bincount(inverse.ravel()).astype(float)
    x, y = rows[:, :-1], rows[:, -1].astype(int)
    onehot = np.eye(classes)[y]
    f = np.zeros((len(x), classes))
    trees: list[list[Tree]] = []
    for _ in range(rounds):
        p = np.exp(f - f.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        each = [_grow(x, weight * (onehot[:, c] - p[:, c]), weight * p[:, c] * (1 - p[:, c]), depth, l2) for c in range(classes)]
        for c, tree in enumerate(each):
            f[:, c] += rate * tree.predict(x)
        trees.append(each)
    return Boosted(classes, trees, rate)
