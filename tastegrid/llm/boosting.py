"""Gradient-boosted trees for two classes, on binned features in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4
ROUNDS = 60
RATE = 0.25
BINS = 32
PENALTY = 1.0


@dataclass
class Trees:
    """Full trees of DEPTH splits: go right where the feature exceeds the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def chances(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Newton steps on the logistic loss; a node without a gain splits nothing off."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    binned = np.column_stack([np.searchsorted(cut, column, "left") for cut, column in zip(cuts, rows.T)])
    width = rows.shape[1]
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(rows), start)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(len(rows), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            size = count * width * BINS
            up = np.bincount(place.ravel(), np.repeat(slope, width), size).reshape(count, width, BINS).cumsum(axis=2)
            down = np.bincount(place.ravel(), np.repeat(bend, width), size).reshape(count, width, BINS).cumsum(axis=2)
            whole_up, whole_down = up[:, :, -1:], down[:, :, -1:]
            gain = up**2 / (down + PENALTY) + (whole_up - up) ** 2 / (whole_down - down + PENALTY) - whole_up**2 / (whole_down + PENALTY)
            gain[(down < 0.5) | (whole_down - down < 0.5)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for own in range(count):
                column, split = divmod(int(best[own]), BINS)
                if gain[own, column, split] > 1e-6 and split < len(cuts[column]):
                    feature[first + own], threshold[first + own] = column, cuts[column][split]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
        node -= 2**DEPTH - 1
        up, down = np.bincount(node, slope, 2**DEPTH), np.bincount(node, bend, 2**DEPTH)
        leaf = RATE * up / (down + PENALTY)
        total += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)
