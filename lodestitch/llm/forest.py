"""A random forest for bounded samples: fitted in memory on binned features, applied to batches of any number.

The sample a classifier is fitted on is bounded by a documented parameter, so the fit needs no cluster; what it is
applied to is not, and is scored in batches by whoever calls ``votes``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins a feature is cut into for finding splits.
BINS = 32


@dataclass
class Forest:
    """Trees as arrays in the order of a complete binary tree: the feature of a node (-1 in a leaf), the value up to
    which rows go left, and the share of positives among the node's rows."""

    feature: np.ndarray
    value: np.ndarray
    share: np.ndarray
    depth: int

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that each row of ``x`` falls into."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, share in zip(self.feature, self.value, self.share):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                below = 2 * at + 1 + (x[rows, f] > value[at])
                at = np.where(f >= 0, below, at)
            total += share[at]
        return total / max(len(self.feature), 1)


def fit(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, least: int = 2) -> Forest:
    """A forest of ``trees`` trees of at most ``depth`` levels of splits on rows ``x`` with labels ``y`` (0 or 1).

    Each tree sees the rows with Poisson weights, each node the square root of the features; splits are the best by
    Gini impurity among the bins' edges, with at least ``least`` rows on either side. The same rows in the same order
    give the same forest. Rows of one label give leaves of that label.
    """
    n, width = x.shape
    # the least value is an edge of its own: what has none of a feature is told from what has little
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.int64)
    rng = np.random.default_rng(seed)
    size, some = 2 ** (depth + 1) - 1, max(1, round(width**0.5))
    feature, value = np.full((trees, size), -1, dtype=np.int64), np.zeros((trees, size))
    share = np.zeros((trees, size))
    for t in range(trees):
        weight = rng.poisson(1.0, n).astype(float)
        rows = np.flatnonzero(weight)
        w, positive, at = weight[rows], weight[rows] * y[rows], np.zeros(len(rows), dtype=np.int64)
        share[t, 0] = positive.sum() / max(w.sum(), 1.0)
        for level in range(depth):
            if not len(rows):
                break
            first, nodes = 2**level - 1, 2**level
            picked = np.argsort(rng.random((nodes, width)), axis=1)[:, :some]
            gain, cut = np.zeros(nodes), np.zeros((nodes, 2), dtype=np.int64)
            for f in range(width):
                mine = (picked == f).any(axis=1)
                use = np.flatnonzero(mine[at - first])
                if not len(use):
                    continue
                key = (at[use] - first) * (BINS + 1) + binned[f][rows[use]]
                count = np.bincount(key, w[use], nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                ones = np.bincount(key, positive[use], nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                whole, all_ones = count[:, -1:], ones[:, -1:]
                right, right_ones = whole - count, all_ones - ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    impurity = ones * (1 - ones / count) + np.where(right > 0, right_ones * (1 - right_ones / right), 0.0)
                    better = np.where((count >= least) & (right >= least), all_ones * (1 - all_ones / whole) - impurity, 0.0)
                better = np.nan_to_num(better)
                best = better.argmax(axis=1)
                now = better[np.arange(nodes), best]
                take = mine & (now > gain + 1e-12)
                gain[take], cut[take, 0], cut[take, 1] = now[take], f, best[take]
            for node in np.flatnonzero(gain > 0):
                f, b = cut[node]
                feature[t, first + node], value[t, first + node] = f, edges[f][b]
            f = feature[t, at]
            goes_on = f >= 0
            rows, w, positive, at, f = rows[goes_on], w[goes_on], positive[goes_on], at[goes_on], f[goes_on]
            at = 2 * at + 1 + (x[rows, f] > value[t, at])
            count, ones = np.bincount(at, w, size), np.bincount(at, positive, size)
            share[t, count > 0] = ones[count > 0] / count[count > 0]
    return Forest(feature, value, share, depth)
