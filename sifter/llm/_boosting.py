"""Gradient-boosted trees for the logistic loss, on small quantised feature matrices."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited regression trees fitted to logistic gradients by histogram split search.

    Features are small non-negative integers (0..bins-1). Raw scores are calibrated by a logistic fit on rows that
    the trees have not seen, so ``predict`` returns probabilities that thresholds can be set on.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.minimum(x, self.bins - 1).astype(np.int64)
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(x, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._leaf(tree, x)
        return self

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for k in range(size):
            own = node == k
            if not own.any():
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[k] = -self.rate * gs / (hs + self.l2)
            if k >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for f in range(x.shape[1]):
                gl = np.cumsum(np.bincount(x[own, f], g[own], self.bins))[:-1]
                hl = np.cumsum(np.bincount(x[own, f], h[own], self.bins))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                if gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                node[own] = 2 * k + 1 + (x[own, best[1]] > best[2])
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]))
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, self.bins - 1).astype(np.int64)
        return sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        s = self.raw(x)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * s + b)))
            d, w = p - target, np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(d * s).sum() + 1e-3 * (a - 1), d.sum()]))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
