"""A small gradient-boosted tree classifier in numpy: logistic loss, histogram splits, calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
#: F1 that may be given up on held-out rows for a lower cut, which finds more, and the lowest cut.
SLACK, LEAST_CUT = 0.01, 0.25


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Complete trees of equal depth: tree t's node i asks feature[t, i] > threshold[t, i] and goes to 2i + 1 or 2i + 2."""

    depth: int = 4
    rounds: int = 60
    rate: float = 0.2
    ridge: float = 1.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    base: float = 0.0
    #: Platt scaling of the raw score, and the probability from which a candidate is taken.
    scale: tuple[float, float] = (1.0, 0.0)
    cut: float = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS))) for j in range(m)]
        edges = [np.unique((e[1:] + e[:-1]) / 2) if len(e) > 1 else e[:0] for e in edges]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if m else np.zeros((n, 0), int)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        feature, threshold, leaf = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, inner + 1))
        for t in range(self.rounds):
            p = _sigmoid(score)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                place = node - first
                best = np.full(width, 1e-6)
                total_g, total_h = np.bincount(place, g, width), np.bincount(place, h, width)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = place * BINS + binned[:, j]
                    left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)[:, : len(e)]
                    left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)[:, : len(e)]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                    gain[(left_h < 0.5) | (right_h < 0.5)] = -1
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    feature[t, first : first + width][better] = j
                    threshold[t, first : first + width][better] = e[at[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
            end = node - inner
            leaf[t] = self.rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + self.ridge)
            score += leaf[t, end]
        self.feature, self.threshold, self.leaf = feature, threshold, leaf
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on held-out rows, then the lowest cut whose F1 there is within SLACK of the best."""
        r, a, b = self.raw(x), 1.0, 0.0
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):
            p = _sigmoid(a * r + b)
            w = np.maximum(p * (1 - p), 1e-6)
            ga, gb = ((p - soft) * r).sum() + 1e-3 * a, (p - soft).sum()
            haa, hab, hbb = (w * r * r).sum() + 1e-3, (w * r).sum(), w.sum() + 1e-9
            d = haa * hbb - hab * hab + 1e-9
            a, b = a - (hbb * ga - hab * gb) / d * 0.5, b - (haa * gb - hab * ga) / d * 0.5
        self.scale = (float(a), float(b))
        p, cuts = self.predict(x), np.linspace(LEAST_CUT, 0.95, 91)
        f1 = np.array([2 * ((p >= c) & (y > 0)).sum() / max(1, (p >= c).sum() + y.sum()) for c in cuts])
        self.cut = float(cuts[f1 >= f1.max() - SLACK][0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.raw(x) + self.scale[1])
