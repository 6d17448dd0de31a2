"""Gradient-boosted trees for weighted rows of small feature vectors, in numpy.

Trees see the features by the bins between their cuts alone, so rows of equal bins may come as one, with their
number as weight.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 40, 3, 0.3, 32, 5, 1.0


@dataclass
class Boosted:
    """Logistic loss; each tree is (feature, threshold, left, right, value) rows."""

    trees: list[list[tuple]] = field(default_factory=list)
    prior: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for k, (feature, threshold, left, right, value) in enumerate(tree):
                here = np.flatnonzero(at == k)
                if feature is None:
                    out[here] += RATE * value
                else:
                    at[here] = np.where(x[here, feature] <= threshold, left, right)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(np.clip(-(a * self.raw(x) + b), -60, 60)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: list[np.ndarray]) -> Boosted:
        """Rows ``x`` with labels ``y``, each ``n`` times; ``cuts`` of every feature, sorted."""
        mean = (y * n).sum() / n.sum()
        own = cls(prior=float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        score = np.full(len(x), own.prior)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = grow(binned, cuts, n * (y - p), n * p * (1 - p), n)
            own.trees.append(tree)
            score = own.raw_more(score, x, tree)
        return own

    @staticmethod
    def raw_more(score: np.ndarray, x: np.ndarray, tree: list[tuple]) -> np.ndarray:
        return score + Boosted([tree]).raw(x)

    def calibrate(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling on rows kept out of the fit (targets pulled in, so it stays finite)."""
        raw = self.raw(x)
        some = (n * y).sum()
        target = np.where(y > 0, (some + 1) / (some + 2), 1 / ((n * (1 - y)).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(np.clip(-(a * raw + b), -60, 60)))
            g = np.array([(n * (target - p) * raw).sum(), (n * (target - p)).sum()])
            w = n * (p * (1 - p) + 1e-9)
            h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-6:
                break
        self.scale = (float(a), float(b))


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[tuple]:
    """One tree by histogram gains, nodes in order of creation."""
    nodes: list = [None]
    todo = [(0, np.arange(len(g)), DEPTH)]
    while todo:
        k, rows, depth = todo.pop()
        total_g, total_h, total_n = g[rows].sum(), h[rows].sum(), n[rows].sum()
        best = (1e-6, None, None)
        if depth and total_n >= 2 * LEAST:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                left_n = np.cumsum(np.bincount(binned[rows, f], n[rows], size))[:-1]
                gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(left_n < LEAST) | (total_n - left_n < LEAST)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
        _, f, at = best
        if f is None:
            nodes[k] = (None, 0.0, -1, -1, float(total_g / (total_h + RIDGE)))
            continue
        left = binned[rows, f] <= at
        nodes[k] = (f, float(cuts[f][at]), len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(len(nodes) - 2, rows[left], depth - 1), (len(nodes) - 1, rows[~left], depth - 1)]
    return nodes
