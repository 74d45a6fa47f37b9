"""Histogram gradient-boosted trees in numpy: fitted on the driver from a bounded sample, traversed as flat arrays on executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete binary trees of one depth, flattened: node k has children 2k+1 and 2k+2.

    feature and threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth). A row goes right where its value is above the threshold.
    """

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def constant(p: float) -> FlatTrees:
    """A model of no trees, for samples with one class or none."""
    p = min(max(p, 0.001), 0.999)
    return FlatTrees(1, float(np.log(p / (1 - p))), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> FlatTrees:
    """Logistic loss, second-order leaves; splits are sought over per-feature quantile histograms, level by level."""
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin k: value <= edges[k]
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            chosen = np.zeros(count, np.int64)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                hg = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hh = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
                gain[(hh < least) | (th - hh < least)] = -1
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first + np.flatnonzero(better)] = j
                threshold[first + np.flatnonzero(better)] = edges[j][at[better]]
                chosen[better] = at[better]
            split = np.isfinite(threshold[node])
            right = np.zeros(n, bool)
            right[split] = x[split, feature[node[split]]] > threshold[node[split]]
            node = 2 * node + 1 + right
        leaf_of = node - inner
        value = -rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + ridge)
        margin += value[leaf_of]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return FlatTrees(depth, base, np.array(features), np.array(thresholds), np.array(values))
