"""Gradient boosting of small regression trees for a yes or no label, calibrated, and compiled to SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A split (feature, threshold, left, right) or a leaf's value."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def sql(self, of: str) -> str:
        if self.feature is None:
            return f"{self.value:.6f}D"
        return f"CASE WHEN {of}.{self.feature} <= {self.threshold:.6f}D THEN {self.left.sql(of)} ELSE {self.right.sql(of)} END"

    def score(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        if self.feature is None:
            return np.full(n, self.value)
        return np.where(x[self.feature] <= self.threshold, self.left.score(x, n), self.right.score(x, n))


@dataclass
class Model:
    trees: list[Tree]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return sum((t.score(x, n) for t in self.trees), np.zeros(n))

    def probability(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))

    def sql(self, of: str) -> str:
        """The calibrated probability, over a struct ``of`` that has the features as fields."""
        total = " + ".join(t.sql(of) for t in self.trees)
        return f"1D / (1D + exp(-({self.slope:.6f}D * ({total}) + {self.offset:.6f}D)))"


def _grow(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    leaf = Tree(value=float(g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    base, best = g.sum() ** 2 / (h.sum() + ridge), (1e-6, None, 0.0)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, gs, hs = v[order], g[order].cumsum(), h[order].cumsum()
        ends = np.flatnonzero(s[1:] > s[:-1])
        ends = ends[(ends + 1 >= least) & (ends + 1 <= len(s) - least)]
        if not len(ends):
            continue
        gain = gs[ends] ** 2 / (hs[ends] + ridge) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + ridge) - base
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), name, float(s[ends[k]] + s[ends[k] + 1]) / 2)
    if best[1] is None:
        return leaf
    at = x[best[1]] <= best[2]
    left, right = (_grow({k: v[m] for k, v in x.items()}, g[m], h[m], depth - 1, least, ridge) for m in (at, ~at))
    return Tree(0.0, best[1], best[2], left, right)


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> Model:
    """Boost on four of five rows; fit the calibration (slope, offset) on the rest."""
    held = np.arange(len(y)) % 5 == 4
    own = {k: v[~held] for k, v in x.items()}
    model, raw = Model([]), np.zeros(int((~held).sum()))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(own, y[~held] - p, p * (1 - p), depth, least, ridge)
        _shrink(tree, rate)
        raw += tree.score(own, len(raw))
        model.trees.append(tree)
    r, t = model.raw({k: v[held] for k, v in x.items()}), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression, with a ridge that keeps the slope finite
        p = 1 / (1 + np.exp(-(a * r + b)))
        w = p * (1 - p)
        grad = np.array([((t - p) * r).sum() - 0.1 * (a - 1), (t - p).sum()])
        hess = np.array([[(w * r * r).sum() + 0.1, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def _shrink(tree: Tree, rate: float) -> None:
    tree.value *= rate
    for t in (tree.left, tree.right):
        if t is not None:
            _shrink(t, rate)
