"""Histogram gradient boosting of one small table, in numpy: what a task does for one symbol and cutoff.

Features are cut into bins by quantiles of the training rows; unknown values have a bin of their own, which each split
tries on both sides. A tree grows level by level: one count of (node, feature, bin) gives the sums of gradients and
curvatures of all candidates at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Settings:
    iterations: int = 200
    depth: int = 3
    rate: float = 0.05
    l2: float = 1.0
    leaf: int = 20
    bins: int = 63


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature, ascending thresholds: midpoints of the known values, or quantiles of them if there are more than
    ``bins``."""
    out = []
    for column in x.T:
        v = np.unique(column[np.isfinite(column)])
        mid = (v[1:] + v[:-1]) / 2
        if len(mid) >= bins:
            mid = np.unique(np.quantile(column[np.isfinite(column)], np.arange(1, bins) / bins, method="midpoint"))
        out.append(mid)
    return out


def binned(x: np.ndarray, thresholds: list[np.ndarray], bins: int) -> np.ndarray:
    """The bin of each value: how many thresholds lie under it; ``bins`` for an unknown one."""
    out = np.full(x.shape, bins, np.int64)
    for f, t in enumerate(thresholds):
        known = np.isfinite(x[:, f])
        out[known, f] = np.searchsorted(t, x[known, f], "left")
    return out


def best_splits(b: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Of each node: the gain of its best split, the feature, the last bin on the left, whether unknown values go left.
    Ties go to the first feature, the lowest bin, and unknown values on the right."""
    n, features = b.shape
    wide = s.bins + 1
    place = (node[:, None] * features + np.arange(features)) * wide + b
    shape = (nodes, features, wide)
    sums = [np.bincount(place.ravel(), np.repeat(w, features), nodes * features * wide).reshape(shape) for w in (g, h, np.ones(n))]
    lefts = [np.cumsum(x[:, :, :-1], axis=2) for x in sums]
    gains = np.full((nodes, features, s.bins, 2), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for side in (0, 1):
            gl, hl, nl = (left + side * x[:, :, -1:] for left, x in zip(lefts, sums, strict=True))
            gt, ht, nt = (x.sum(2, keepdims=True) for x in sums)
            gain = gl**2 / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt**2 / (ht + s.l2)
            gains[..., side] = np.where((nl >= s.leaf) & (nt - nl >= s.leaf), gain, -np.inf)
    flat = np.round(gains, 12).reshape(nodes, -1)
    at = flat.argmax(1)
    feature, rest = np.divmod(at, s.bins * 2)
    return flat[np.arange(nodes), at], feature, rest // 2, rest % 2


@dataclass
class Model:
    thresholds: list[np.ndarray]
    base: float
    #: Of each tree and level: features, last bins on the left, whether unknown values go left; then the leaves' values.
    trees: list[tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]]
    bins: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.thresholds, self.bins)
        f = np.full(len(x), self.base)
        for levels, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in levels:
                node = descend(b, node, level, self.bins)
            f += values[node]
        return 1 / (1 + np.exp(-f))


def descend(b: np.ndarray, node: np.ndarray, level: tuple[np.ndarray, np.ndarray, np.ndarray], bins: int) -> np.ndarray:
    """The children: 2 * node on the left. A node that is not split (bin -1) sends all to the left."""
    feature, last, unknown = (x[node] for x in level)
    own = b[np.arange(len(b)), feature]
    left = np.where(own == bins, unknown == 1, own <= last) | (last < 0)
    return 2 * node + ~left


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:  # noqa: B008
    """A classifier of labels 0 and 1, both of which occur, by the logistic loss."""
    thresholds = cuts(x, s.bins)
    b = binned(x, thresholds, s.bins)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    f, trees = np.full(len(y), base), []
    for _ in range(s.iterations):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node, levels = np.zeros(len(y), np.int64), []
        for depth in range(s.depth):
            gain, feature, last, unknown = best_splits(b, node, 1 << depth, g, h, s)
            last = np.where(gain > 0, last, -1)
            levels.append((feature, last, unknown))
            node = descend(b, node, levels[-1], s.bins)
        leaves = 1 << s.depth
        values = -s.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + s.l2)
        trees.append((levels, values))
        f += values[node]
    return Model(thresholds, base, trees, s.bins)
