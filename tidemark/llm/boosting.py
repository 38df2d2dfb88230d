"""Gradient-boosted trees for a yes-or-no target on a bounded sample, in histogram form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``depth`` levels of (feature, limit) per tree and a value per leaf; rows above a limit go right."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, limits, values in zip(self.features, self.limits, self.values):
            at = np.zeros(len(x), dtype=np.int64)
            while at.size and at[0] < len(features):
                at = 2 * at + 1 + (x[rows, features[at]] > limits[at])
            out += values[at - len(features)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss; splits at quantiles, ties to the first feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), 2 ** depth - 1
    all_features, all_limits, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        features, limits, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows):
                features[node], limits[node] = _split(binned[rows], grad[rows], hess[rows], cuts)
            at[rows] = 2 * node + 1 + (x[rows, features[node]] > limits[node])
        leaf = at - inner
        top = np.bincount(leaf, grad, inner + 1)
        values = rate * top / (np.bincount(leaf, hess, inner + 1) + 1)
        score += values[leaf]
        all_features.append(features)
        all_limits.append(limits)
        all_values.append(values)
    return Trees(base, np.array(all_features), np.array(all_limits), np.array(all_values))


def _split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    best, found = 1e-6, (0, np.inf)
    g_all, h_all = grad.sum(), hess.sum()
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        g = np.cumsum(np.bincount(binned[:, f], grad, len(c) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], hess, len(c) + 1))[:-1]
        gain = g ** 2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all ** 2 / (h_all + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, float(c[k]))
    return found
