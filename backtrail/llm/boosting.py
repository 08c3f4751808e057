"""Gradient-boosted trees of equal depth for the logistic loss, in numpy.

For bounded samples of dense features; every tree splits on binned values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, RATE, BINS, RIDGE = 60, 3, 0.15, 48, 2.0


@dataclass(frozen=True)
class Trees:
    """Each tree is complete: inner nodes by level, then 2^depth leaf values."""

    start: float
    features: np.ndarray    # (trees, inner nodes)
    cuts: np.ndarray
    leaves: np.ndarray      # (trees, leaves)

    @staticmethod
    def empty() -> Trees:
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        here = np.arange(len(rows))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(rows), int)
            while len(rows) and node[0] < len(feature):
                node = 2 * node + 1 + (rows[here, feature[node]] > cut[node])
            total += leaf[node - len(feature)] if len(rows) else 0.0
        return total


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS,
         depth: int = DEPTH) -> Trees:
    """Trees for labels 0 and 1 with row weights."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    w = w / w.mean()
    rate = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
    start = float(np.log(rate / (1 - rate)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            cut_bin = np.full(count, BINS + 1)
            for j in range(width):
                key = (node - first) * (BINS + 1) + binned[:, j]
                g = np.bincount(key, grad, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                h = np.bincount(key, hess, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (gt - g)**2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((h > 1.0) & (ht - h > 1.0), gain, -1.0)[:, :len(edges[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + count][better] = j
                cut[first:first + count][better] = edges[j][at[better]]
                cut_bin[better] = at[better]
            node_at = node - first
            right = binned[np.arange(n), feature[node]] > cut_bin[node_at]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        values = RATE * g / (h + RIDGE)
        margin += values[leaf]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(values)
    return Trees(start, np.array(all_features), np.array(all_cuts), np.array(all_leaves))
