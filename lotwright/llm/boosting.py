"""Histogram gradient-boosted trees for a binary label.

Training bins each feature by quantiles of a bounded sample and grows trees level by
level from gradient histograms. A model is flattened into one set of arrays over the
nodes of all trees, which numpy walks for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees. A leaf is its own child; `roots` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def _best_splits(binned: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, bins: int, l2: float, least: float):
    """For each slot: gain, feature and bin of its best split, from gradient histograms."""
    features = binned.shape[1]
    index = (slot[:, None] * features + np.arange(features)) * bins + binned
    size = slots * features * bins
    hist = [np.bincount(index.ravel(), np.repeat(v, features), size).reshape(slots, features, bins) for v in (g, h)]
    gl, hl = (x.cumsum(axis=2) for x in hist)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    gain[(hl < least) | (ht - hl < least)] = -np.inf
    flat = gain.reshape(slots, -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(slots), best], best // bins, best % bins


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Boost `trees` trees on the log loss. With no rows, or one label only, a constant."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if len(y) == 0 or y.min() == y.max():
        roots.append(leaf())
        trees = 0
    else:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf())
        at = np.full(len(y), roots[-1])
        open_nodes = [roots[-1]]
        for _ in range(depth):
            if not open_nodes:
                break
            slot_of = {n: i for i, n in enumerate(open_nodes)}
            inside = np.isin(at, open_nodes)
            slot = np.array([slot_of[n] for n in at[inside].tolist()], np.int64)
            gains, fs, bs = _best_splits(binned[inside], slot, len(open_nodes), g[inside], h[inside], bins, l2, least)
            grown = []
            for n, gain, f, b in zip(list(open_nodes), gains, fs, bs, strict=True):
                if gain <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[n], threshold[n], left[n], right[n] = int(f), float(edges[f][b]), leaf(), leaf()
                here = at == n
                low = here & (binned[:, f] <= b)
                at[low], at[here & ~low] = left[n], right[n]
                grown += [left[n], right[n]]
            open_nodes = grown
        for n in np.unique(at).tolist():
            here = at == n
            value[n] = float(-rate * g[here].sum() / (h[here].sum() + l2))
        margin = margin + np.asarray(value)[at]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)
