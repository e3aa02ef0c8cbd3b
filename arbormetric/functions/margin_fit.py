"""Fit of a soft-margin classifier on a precomputed kernel: the fit function of the grid search."""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-6
ROUNDS = 200_000


def fit_margin(kernel: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float, bool]:
    """Weights and shift of the decision value ``kernel @ weights + shift``, and whether the fit
    converged within ROUNDS moves."""
    if np.all(y == y[0]):
        return np.zeros(len(y)), float(y[0]), True
    a, offset, converged = _fit(kernel, y, c)
    return a * y, -offset, converged


def _fit(k: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float, bool]:
    """Dual by pairs: the most violating one and its best partner, until none violates."""
    a, gradient, diagonal = np.zeros(len(y)), -np.ones(len(y)), np.diag(k)
    positive, converged = y > 0, False
    for _ in range(ROUNDS):
        score = -y * gradient
        up = np.where(positive, a < c, a > 0)
        low = np.where(positive, a > 0, a < c)
        i = int(np.where(up, score, -np.inf).argmax())
        if score[i] - np.where(low, score, np.inf).min() < TOLERANCE:
            converged = True
            break
        gap = score[i] - score
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        step = min(step, c - a[i] if positive[i] else a[i], a[j] if positive[j] else c - a[j])
        a[i] = min(max(a[i] + y[i] * step, 0.0), c)
        a[j] = min(max(a[j] - y[j] * step, 0.0), c)
        gradient += y * step * (k[i] - k[j])
    score = -y * gradient
    free = (a > 1e-12 * c) & (a < c * (1 - 1e-12))
    if free.any():
        return a, -float(score[free].mean()), converged
    up = np.where(positive, a < c, a > 0)
    low = np.where(positive, a > 0, a < c)
    return a, -float((score[up].max() + score[low].min()) / 2), converged
