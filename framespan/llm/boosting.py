"""Gradient-boosted trees on histograms, kept as flat arrays that numpy walks for all rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has the children 2k+1 and 2k+2.

    ``feature`` and ``threshold`` are (trees, 2**depth - 1), ``value`` is (trees, 2**depth);
    a node that does not split has the threshold infinity.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        trees, nodes = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range((nodes + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        total = self.base + self.value[tree, at - nodes].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """Fit trees to labels 0 and 1 by logistic loss; without rows, or with one label, a constant."""
    nodes = (1 << depth) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    model = Trees(base, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)))
    if not 0 < y.sum() < len(y):
        return model
    x = x.astype(np.float64)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slot = at - first
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                key = slot * bins + binned[:, f]
                g, h, n = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (grad, hess, None))
                gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(n < least) | (nt - n < least)] = 0
                gain[:, len(edges[f]) :] = 0
                cut = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), cut] > best):
                    best[k] = gain[k, cut[k]]
                    model.feature[t, first + k], model.threshold[t, first + k] = f, edges[f][cut[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - nodes
        g, h = np.bincount(leaf, grad, nodes + 1), np.bincount(leaf, hess, nodes + 1)
        model.value[t] = rate * g / (h + l2)
        total = total + model.value[t][leaf]
    return model
