"""Gradient-boosted trees for a binary label: histogram splits, logistic loss, monotonic constraints.

A fitted model is a set of flat node arrays, so scoring walks all rows one level at a time. Fitting is for a bounded
sample on the driver; scoring runs inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees; a leaf points to itself. Row goes left where its feature is <= the threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label for each row of x (rows, features)."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotonic: dict[int, int] | None = None,
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    smallest_leaf: int = 5,
    penalty: float = 1.0,
) -> Trees:
    """Trees for P(y = 1). monotonic: +1 or -1 for features that may only raise or only lower the score.

    A split that breaks a constraint is not taken, and the children of a constrained split are bounded by its middle,
    so the whole ensemble keeps the direction. Ties go to the lowest feature and bin.
    """
    monotonic = monotonic or {}
    n, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(n_features)], axis=1)
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(leaf: float) -> int:
        node = len(value)
        feature.append(0), threshold.append(0.0), left.append(node), right.append(node), value.append(leaf)
        return node

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        node = add(rate * float(np.clip(-total_g / (total_h + penalty), low, high)))
        best = None
        if level < depth and len(rows) >= 2 * smallest_leaf:
            for f in range(n_features):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                b = binned[rows, f]
                lg, lh = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h))
                ln = np.cumsum(np.bincount(b, minlength=size))[:-1]
                rg, rh = total_g - lg, total_h - lh
                to_left, to_right = (np.clip(-a / (c + penalty), low, high) for a, c in ((lg, lh), (rg, rh)))
                gain = lg**2 / (lh + penalty) + rg**2 / (rh + penalty) - total_g**2 / (total_h + penalty)
                allowed = (ln >= smallest_leaf) & (len(rows) - ln >= smallest_leaf)
                allowed &= monotonic.get(f, 0) * (to_right - to_left) >= 0
                gain = np.where(allowed, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                    best = (gain[k], f, k, (to_left[k] + to_right[k]) / 2)
        if best:
            _, f, k, middle = best
            goes_left = binned[rows, f] <= k
            sign = monotonic.get(f, 0)
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (l_low, l_high), (r_low, r_high) = bounds.get(sign, ((low, high), (low, high)))
            feature[node], threshold[node] = f, float(edges[f][k])
            left[node] = grow(rows[goes_left], level + 1, l_low, l_high)
            right[node] = grow(rows[~goes_left], level + 1, r_low, r_high)
        return node

    def built() -> Trees:
        arrays = (np.array(a) for a in (roots, feature, threshold, left, right, value))
        return Trees(*arrays, base=base, depth=depth)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        start = len(value)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        if len(value) == start + 1 and abs(value[start]) < 1e-9:
            break
        node = np.full(n, roots[-1])
        f_, t_, l_, r_, v_ = (np.array(a) for a in (feature, threshold, left, right, value))
        for _ in range(depth):
            node = np.where(x[np.arange(n), f_[node]] <= t_[node], l_[node], r_[node])
        margin += v_[node]
    return built()
