"""Gradient-boosted trees for two classes in numpy: small models, fitted on the driver on bounded samples, applied in Arrow batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, depth-limited trees over quantile bins, shrinkage; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []  # a heap: (feature or -1, cut, value)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1))
            groups = {1: np.arange(len(y))}
            for node in range(1, 2 ** (self.depth + 1)):
                if (rows := groups.pop(node, None)) is None:
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(self.rate * gs / (hs + 1.0))
                best = (1e-6, -1, 0)
                if node < 2**self.depth and len(rows) >= 2 * self.least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    tree[node] = (-1, 0.0, value)
                    score[rows] += value
                else:
                    _, f, k = best
                    tree[node] = (f, float(cuts[f][k]), 0.0)
                    left = binned[rows, f] <= k
                    groups[2 * node], groups[2 * node + 1] = rows[left], rows[~left]
            self.trees.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        x = np.asarray(x, float)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            node = np.ones(len(x), int)
            feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                node = np.where(go, 2 * node + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out
