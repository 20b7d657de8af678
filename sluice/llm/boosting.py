"""Gradient-boosted trees for two classes, in numpy, small enough to broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: split features, split values and leaf values, by tree."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits are searched among ``bins`` quantiles of each feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total = np.full(len(y), base)
    features, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, value = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(2**depth - 1):
            own = np.flatnonzero(node == at)
            best = 1e-9
            split = None
            for j, e in enumerate(edges):
                if not len(e) or not len(own):
                    continue
                g = np.cumsum(np.bincount(binned[own, j], grad[own], len(e) + 1))
                h = np.cumsum(np.bincount(binned[own, j], hess[own], len(e) + 1))
                gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, split = gain[k], (j, k)
            right = np.zeros(len(own), bool)
            if split:
                feature[at], value[at] = split[0], edges[split[0]][split[1]]
                right = binned[own, split[0]] > split[1]
            node[own] = 2 * at + 1 + right
        own = node - len(feature)
        leaf = rate * np.bincount(own, grad, 2**depth) / (np.bincount(own, hess, 2**depth) + ridge)
        total += leaf[own]
        features.append(feature)
        values.append(value)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(values), np.array(leaves), base)
