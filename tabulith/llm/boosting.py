"""Gradient-boosted trees in numpy: histogram fit with monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in shared node arrays. A row goes to left[node] + (x[feature] > cut).

    A leaf leads to itself: its cut is infinite and left is its own place.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit the log-odds of y (0/1) on x.

    monotone: for each feature 1 (the odds never fall as it grows), -1 (never rise) or 0.
    A split on such a feature is taken only if its sides are in that order, and the two
    sides' values are kept apart by their mean further down. With one class or no rows
    the forest is a constant.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, cut, left, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
        coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            root = len(nodes)
            roots.append(root)
            nodes.append([0, np.inf, root, 0.0])
            place = np.full(n, root)
            level = {root: (-np.inf, np.inf)}
            for _ in range(depth):
                after = {}
                for node, (low, high) in level.items():
                    at = np.flatnonzero(place == node)
                    split = _best(coded[at], g[at], h[at], [len(e) for e in edges], monotone, l2, least, low, high)
                    if split is None:
                        continue
                    f, k, worth_left, worth_right = split
                    left = len(nodes)
                    nodes[node] = [f, edges[f][k], left, 0.0]
                    nodes.extend([[0, np.inf, left, worth_left * rate], [0, np.inf, left + 1, worth_right * rate]])
                    place[at] = left + (coded[at, f] > k)
                    middle = (worth_left + worth_right) / 2
                    after[left] = (middle if monotone[f] < 0 else low, middle if monotone[f] > 0 else high)
                    after[left + 1] = (middle if monotone[f] > 0 else low, middle if monotone[f] < 0 else high)
                level = after
            if nodes[root][1] == np.inf:
                nodes.pop()
                roots.pop()
                break
            raw += np.array([v[3] for v in nodes[root:]])[place - root]
    flat = np.array(nodes or [[0, np.inf, 0, 0.0]], float)
    return Forest(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3], np.array(roots, np.int64), depth, base)


def _best(coded, g, h, cuts, monotone, l2, least, low, high):
    """(feature, cut number, left value, right value) with the largest gain, or None."""
    total_g, total_h, n = g.sum(), h.sum(), len(g)
    found, gain = None, 1e-6
    for f, size in enumerate(cuts):
        if not size:
            continue
        sums = [np.cumsum(np.bincount(coded[:, f], weights=w, minlength=size + 1))[:size] for w in (g, h, None)]
        lg, lh, ln = sums
        lv = np.clip(lg / (lh + l2), low, high)
        rv = np.clip((total_g - lg) / (total_h - lh + l2), low, high)
        worth = lambda v, a, b: a * v - 0.5 * (b + l2) * v * v
        whole = np.clip(total_g / (total_h + l2), low, high)
        gains = worth(lv, lg, lh) + worth(rv, total_g - lg, total_h - lh) - worth(whole, total_g, total_h)
        gains[(ln < least) | (n - ln < least) | (monotone[f] * (rv - lv) < 0)] = -np.inf
        k = int(np.argmax(gains))
        if gains[k] > gain:
            gain, found = gains[k], (f, k, float(lv[k]), float(rv[k]))
    return found
