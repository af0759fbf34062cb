"""Gradient-boosted trees for a bounded table, with log loss on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
    """Newton boosting: each split has the largest gain of the second-order loss over all features and bins."""
    mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    start, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    cell = binned + np.arange(x.shape[1]) * bins
    score, out = np.full(len(y), start), Trees(*(np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, np.float64), (inner + 1, np.float64))), start)
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (x.shape[1] * bins) + cell).ravel()
            total = lambda v: np.bincount(where, np.repeat(v, x.shape[1]), nodes * x.shape[1] * bins).reshape(nodes, x.shape[1], bins)  # noqa: E731,B023
            gl, hl = np.cumsum(total(g), 2), np.cumsum(total(h), 2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // bins, best % bins
            out.feature[k, first : first + nodes] = f
            out.limit[k, first : first + nodes] = [cuts[i][j] if j < len(cuts[i]) else np.inf for i, j in zip(f.tolist(), b.tolist(), strict=True)]
            n = at - first
            at = 2 * at + 1 + (binned[np.arange(len(y)), f[n]] > b[n])
        leaf = at - inner
        out.value[k] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + least)
        score = score + out.value[k][leaf]
    return out
