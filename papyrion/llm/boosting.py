"""Gradient-boosted trees for a small labelled sample, and their form as a Spark expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, threshold, left, right): left where the feature is at most the threshold; or a leaf's value.
Tree = tuple | float


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, cuts: list[np.ndarray], ridge: float) -> Tree:
    leaf = float(grad.sum() / (hess.sum() + ridge))
    if depth == 0 or len(x) < 10:
        return leaf
    best, split = 1e-9, None
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for f, values in enumerate(cuts):
        for cut in values:
            left = x[:, f] <= cut
            n = left.sum()
            if n < 3 or len(x) - n < 3:
                continue
            g, h = grad[left].sum(), hess[left].sum()
            gain = g * g / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge) - whole
            if gain > best:
                best, split = gain, (f, float(cut))
    if split is None:
        return leaf
    left = x[:, split[0]] <= split[1]
    return (*split, _grow(x[left], grad[left], hess[left], depth - 1, cuts, ridge), _grow(x[~left], grad[~left], hess[~left], depth - 1, cuts, ridge))


def apply_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, apply_tree(left, x), apply_tree(right, x))


class Boosted:
    """Logistic boosting: ``score`` is a log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rate = rate
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        cuts = []
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            middles = (values[1:] + values[:-1]) / 2
            cuts.append(np.unique(np.quantile(middles, np.linspace(0, 1, 16))) if len(middles) > 16 else middles)
        total = np.full(len(x), self.base)
        self.trees: list[Tree] = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            tree = _grow(x, y - p, p * (1 - p), depth, cuts, ridge)
            total += rate * apply_tree(tree, x)
            self.trees.append(tree)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(apply_tree(t, x) for t in self.trees)

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The score as an expression of feature columns."""

        def walk(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree * self.rate)
            f, cut, left, right = tree
            return F.when(feature(f) <= F.lit(cut), walk(left)).otherwise(walk(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold of at least even odds with the target precision on held-out rows; infinite if none.

    It lies between two scores, so that sums in another order fall on the same side.
    """
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_tie = np.append(ranked[1:] < ranked[:-1] - 1e-9, True)[: len(y)]
    good = np.flatnonzero((hits >= precision) & last_of_tie)
    if not len(good):
        return float("inf")
    at = good[-1]
    below = ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 2
    return max(0.0, float(ranked[at] + below) / 2)
