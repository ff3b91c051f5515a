"""Gradient-boosted trees for the log loss, on small whole-number features (numpy only)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: arrays trees x inner nodes and trees x leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    #: Platt calibration of the margin, fitted on rows that no tree has seen.
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - (leaf.size - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0) -> Trees:
    """Newton boosting; each level picks for each node the cut of largest gain over all values."""
    x, y = np.asarray(x, np.int64), np.asarray(y, float)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    low, width = x.min(0), int((x.max(0) - x.min(0)).max()) + 1
    shifted = x - low
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.iinfo(np.int32).max, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            best = np.zeros(nodes)
            for f in range(x.shape[1]):
                key = (at - first) * width + shifted[:, f]
                sg = np.bincount(key, weights=g, minlength=nodes * width).reshape(nodes, width).cumsum(1)
                sh = np.bincount(key, weights=h, minlength=nodes * width).reshape(nodes, width).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + least) + (tg - sg) ** 2 / (th - sh + least) - tg**2 / (th + least)
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + nodes] = np.where(better, f, feature[first : first + nodes])
                cut[first : first + nodes] = np.where(better, k + low[f], cut[first : first + nodes])
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        place = at - (2**depth - 1)
        leaf = -rate * np.bincount(place, weights=g, minlength=2**depth) / (np.bincount(place, weights=h, minlength=2**depth) + least)
        margin += leaf[place]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base)


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 500) -> None:
    """Platt scaling by gradient steps on held-back rows."""
    m, y = model.margin(np.asarray(x, np.int64)), np.asarray(y, float)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30))) - target
        slope -= 0.05 * (d * m).mean()
        shift -= 0.05 * d.mean()
    model.slope, model.shift = slope, shift
