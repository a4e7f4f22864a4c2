"""Small gradient-boosted trees: fitted on the driver from weighted rows, scored as a Column.

Fitting is plain NumPy on at most some ten thousand distinct rows; a row's weight says how often it occurs. A fitted model is a sum of nested CASE
expressions, so scoring stays inside Spark's own expressions, also within higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out

    def column(self, at: Callable[[int], Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(at(self.feature) <= float(self.cut), self.low.column(at)).otherwise(self.high.column(at))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    value = g.sum() / (h.sum() + ridge)
    best, gain = None, 1e-6
    if depth and w.sum() >= 2 * least:
        base = g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch, cw = x[order, f], g[order].cumsum(), h[order].cumsum(), w[order].cumsum()
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(cw[at] >= least) & (cw[-1] - cw[at] >= least)]
            if len(at):
                s = cg[at] ** 2 / (ch[at] + ridge) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + ridge) - base
                i = int(np.argmax(s))
                if s[i] > gain:
                    best, gain = (f, float(v[at[i]] + v[at[i] + 1]) / 2), s[i]
    if best is None:
        return Tree(value=value)
    left = x[:, best[0]] <= best[1]
    return Tree(best[0], best[1], _grow(x[left], g[left], h[left], w[left], depth - 1, least, ridge), _grow(x[~left], g[~left], h[~left], w[~left], depth - 1, least, ridge))


@dataclass
class Boosted:
    base: float = 0.0
    rate: float = 0.3
    #: What features were rounded to, if they were.
    step: int = 1
    trees: list[Tree] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0, weight: np.ndarray | None = None) -> "Boosted":
        """Logistic loss; x (rows, features), y of 0 and 1; weight: how often a row counts (once)."""
        w = np.ones(len(x)) if weight is None else weight
        p = min(max(float(np.average(y, weights=w)) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        model = cls(float(np.log(p / (1 - p))), rate)
        raw = np.full(len(x), model.base)
        for _ in range(trees if len(x) else 0):
            q = 1 / (1 + np.exp(-raw))
            tree = _grow(x, w * (y - q), w * q * (1 - q), w, depth, least, ridge)
            model.trees.append(tree)
            raw += rate * tree.predict(x)
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-raw))

    def column(self, at: Callable[[int], Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + F.lit(self.rate) * t.column(at)
        return 1 / (1 + F.exp(-total))


def threshold(score: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """Least score at which held-out rows reach the precision; above 1 if none does. weight: how often a row counts (once)."""
    order = np.argsort(-score, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    right = np.cumsum((w * y)[order]) / np.cumsum(w[order])
    last = np.append(np.diff(score[order]) != 0, True)
    good = np.flatnonzero((right >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 2.0
