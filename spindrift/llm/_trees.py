"""Decision trees in arrays: a random forest and gradient boosting for small, bounded training sets.

Features are cut into at most 32 classes at quantiles; a split is a feature and a class. Both models are
fitted on the driver from rows whose number the callers bound, and applied to whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES = 32


@dataclass
class Trees:
    """cuts[f]: where the classes of feature f end. Node i of tree t splits on feature[t, i] at cut[t, i] and
    goes on at 2 i + 1 (not above) or 2 i + 2; feature -1 is a leaf with value[t, i]."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    boosted: bool

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of the positive class, for rows of features."""
        n = len(x)
        total = np.zeros(n)
        for t in range(len(self.feature)):
            at = np.zeros(n, np.int64)
            while True:
                f = self.feature[t, at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                right = x[inner, f[inner]] > self.cut[t, at[inner]]
                at[inner] = 2 * at[inner] + 1 + right
            total += self.value[t, at]
        if self.boosted:
            return 1 / (1 + np.exp(-np.clip(self.base + total, -30, 30)))
        return total / max(1, len(self.feature))


def _classes(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    cuts, out = [], np.zeros(x.shape, np.int64, order="F")
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > CLASSES:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CLASSES + 1)[1:]))
        middle = (values[:-1] + values[1:]) / 2
        cuts.append(middle)
        out[:, f] = np.searchsorted(middle, x[:, f], "left")
    return cuts, out


def _tree(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, damp: float, tried: np.ndarray | None, rng: np.random.Generator, leaf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree that lowers the sum of squares of grad / hess, level by level."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    rows = {0: np.arange(len(binned))}
    for node in range(size):
        own = rows.pop(node, None)
        if own is None:
            continue
        g, h = grad[own].sum(), hess[own].sum()
        value[node] = leaf(g, h)
        if 2 * node + 2 >= size or h < 2 * least:
            continue
        best = (1e-9, -1, 0)
        candidates = range(binned.shape[1]) if tried is None else rng.choice(binned.shape[1], tried, replace=False)
        for f in candidates:
            k = len(cuts[f])
            if not k:
                continue
            gs = np.bincount(binned[own, f], grad[own], k + 1).cumsum()[:-1]
            hs = np.bincount(binned[own, f], hess[own], k + 1).cumsum()[:-1]
            gain = gs**2 / (hs + damp) + (g - gs) ** 2 / (h - hs + damp) - g**2 / (h + damp)
            gain[(hs < least) | (h - hs < least)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], int(f), c)
        if best[1] >= 0:
            feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
            low = binned[own, best[1]] <= best[2]
            rows[2 * node + 1], rows[2 * node + 2] = own[low], own[~low]
    return feature, cut, value


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 1) -> Trees:
    """Forest for labels 0 and 1: each tree on a sample drawn with replacement, each split on some features."""
    rng = np.random.default_rng(seed)
    cuts, binned = _classes(x)
    tried = max(2, int(np.sqrt(x.shape[1]) + 1))
    parts = []
    for _ in range(trees):
        own = rng.integers(0, len(x), len(x))
        parts.append(_tree(binned[own], cuts, y[own].astype(float), np.ones(len(own)), depth, 2, 1e-9, tried, rng, lambda g, h: g / max(h, 1e-9)))
    return Trees(cuts, *(np.stack(c) for c in zip(*parts, strict=True)), 0.0, False)


def boosted_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, seed: int = 1) -> Trees:
    """Boosting on the log-likelihood of labels 0 and 1."""
    rng = np.random.default_rng(seed)
    cuts, binned = _classes(x)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    out, parts = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-out))
        part = _tree(binned, cuts, y - p, np.maximum(p * (1 - p), 1e-6), depth, 1.0, 1.0, None, rng, lambda g, h: rate * g / (h + 1.0))
        parts.append(part)
        one = Trees(cuts, *(c[None] for c in part), 0.0, False)
        out += one.probability(x)
    return Trees(cuts, *(np.stack(c) for c in zip(*parts, strict=True)), base, True)
