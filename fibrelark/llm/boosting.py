"""Gradient-boosted trees for a yes/no label, on quantile bins, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth; ``raw`` gives the log odds."""

    n_trees: int = 60
    depth: int = 4
    rate: float = 0.25
    ridge: float = 1.0
    bins: int = 32
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        """Newton steps of the logistic loss; the best split of each node over all features and bins."""
        n, width = rows.shape
        weights = np.ones(n) if weights is None else weights
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(width)], axis=1)
        share = np.clip((weights * labels).sum() / weights.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            slope, bend = weights * (labels - p), weights * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            features, limits = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                here = node - first
                best = np.full(count, 1e-9)
                cut = np.zeros((count, 2), np.int64) - 1
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    k = len(edges[f]) + 1
                    at = here * k + binned[:, f]
                    g = np.bincount(at, slope, count * k).reshape(count, k)
                    h = np.bincount(at, bend, count * k).reshape(count, k)
                    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    top = gain.argmax(1)
                    value = gain[np.arange(count), top]
                    better = value > best
                    best[better] = value[better]
                    cut[better] = np.stack([np.full(count, f), top], axis=1)[better]
                for k in np.flatnonzero(cut[:, 0] >= 0):
                    f, b = cut[k]
                    features[first + k], limits[first + k] = f, edges[f][b]
                node = 2 * node + 1 + (rows[np.arange(n), features[node]] > limits[node])
            leaf = node - (2**self.depth - 1)
            values = self.rate * np.bincount(leaf, slope, 2**self.depth) / (np.bincount(leaf, bend, 2**self.depth) + self.ridge)
            score += values[leaf]
            self.splits.append((features, limits, values))
        return self

    def raw(self, rows: np.ndarray) -> np.ndarray:
        score = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for features, limits, values in self.splits:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, features[node]] > limits[node])
            score += values[node - (2**self.depth - 1)]
        return score
