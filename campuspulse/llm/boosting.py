"""Gradient-boosted trees on binned features, fitted on a table of counts.

Rows with equal bins are one weighted cell, so fitting reads a bounded table whatever the number of rows behind it; a fitted
forest is a plain column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    bin: int  # goes left at most at this bin
    left: Leaf | Split
    right: Leaf | Split


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: list[int], depth: int, l2: float) -> Leaf | Split:
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    if depth:
        for f, k in enumerate(bins):
            gl = np.cumsum(np.bincount(x[:, f], grad, k))[:-1]
            hl = np.cumsum(np.bincount(x[:, f], hess, k))[:-1]
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    _, f, b = best
    if f is None:
        return Leaf(float(g / (h + l2)))
    left = x[:, f] <= b
    return Split(f, b, *(_grow(x[s], grad[s], hess[s], bins, depth - 1, l2) for s in (left, ~left)))


def _values(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.bin, _values(tree.left, x), _values(tree.right, x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Forest:
    """``probability(x)`` is a calibrated probability; ``cut`` the least margin that is accepted."""

    def __init__(self, trees: list, rate: float, start: float, slope: float = 1.0, shift: float = 0.0, cut: float = float("inf")):
        self.trees, self.rate, self.start, self.slope, self.shift, self.cut = trees, rate, start, slope, shift, cut

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)

    def margin_column(self, features: list[Column]) -> Column:
        """The margin as an expression of the features' columns."""

        def column(tree) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(self.rate * tree.value)
            return F.when(features[tree.feature] <= tree.bin, column(tree.left)).otherwise(column(tree.right))

        return sum((column(t) for t in self.trees), F.lit(self.start))


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, bins: list[int], rounds: int = 30, depth: int = 2, rate: float = 0.3, l2: float = 1.0) -> Forest:
    """Logistic boosting on cells ``x`` with so many positive and negative rows each."""
    total = positive + negative
    p, n = positive.sum() + 0.5, negative.sum() + 0.5
    forest = Forest([], rate, float(np.log(p / n)))
    margin = np.full(len(x), forest.start)
    for _ in range(rounds if len(x) else 0):
        prob = _sigmoid(margin)
        tree = _grow(x, positive - total * prob, total * prob * (1 - prob), bins, depth, l2)
        if isinstance(tree, Leaf) and abs(tree.value) < 1e-6:
            break
        forest.trees.append(tree)
        margin = margin + rate * _values(tree, x)
    return forest


def calibrate(forest: Forest, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, target: float) -> None:
    """Fit slope and shift of the probability on other rows, and the cut from which their calibrated probability reaches ``target``."""
    z, total = forest.margin(x), positive + negative
    a, b = 1.0, 0.0
    for _ in range(20 if len(x) else 0):
        prob = _sigmoid(a * z + b)
        r, w = positive - total * prob, total * prob * (1 - prob)
        hess = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1.0]])
        step = np.linalg.solve(hess, np.array([(r * z).sum() - (a - 1.0), r.sum() - b]))
        a, b = a + step[0], b + step[1]
    forest.slope, forest.shift = float(max(a, 1e-3)), float(b)
    forest.cut = float((np.log(target / (1 - target)) - forest.shift) / forest.slope) if positive.sum() else float("inf")
