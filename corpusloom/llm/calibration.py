"""Isotonic calibration by pooling adjacent violators, shared by the two scoring operators."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A non-decreasing map from raw scores to probabilities, linear between the pools' centres."""

    def __init__(self, raw: np.ndarray, label: np.ndarray):
        if not len(raw):
            self.x, self.y = np.array([0.0]), np.array([0.5])
            return
        x, inverse = np.unique(np.asarray(raw, float), return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, np.asarray(label, float)) / weight
        pools: list[list[float]] = []  # [mean, weight, weighted sum of x]
        for v, w, at in zip(mean, weight, x):
            pools.append([v, w, at * w])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                v2, w2, s2 = pools.pop()
                v1, w1, s1 = pools.pop()
                pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
        self.x = np.array([s / w for _, w, s in pools])
        self.y = np.array([v for v, _, _ in pools])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
