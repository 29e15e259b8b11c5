"""Small linear classifiers, fitted on a bounded sample: support vector machine, logistic regression, calibration."""

from __future__ import annotations

import numpy as np

#: Steps of the accelerated gradient descent, and the weight of the squared length of the solution.
STEPS, PENALTY = 120, 1e-4


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(values, -60, 60)))


def fit(rows: np.ndarray, signs: np.ndarray, loss: str, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (the last is the intercept) that separate rows of sign +1 from rows of sign -1.

    ``loss`` is ``hinge`` (squared, the linear support vector machine) or ``logistic``. Both signs weigh
    the same in total. Rows have bounded length, so the step size is a constant.
    """
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    share = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())).astype(np.float32)
    length = float((rows * rows).sum(axis=1).max())
    step = 1.0 / ((2.0 if loss == "hinge" else 0.25) * length + penalty)
    weights = np.zeros(rows.shape[1], np.float32)
    ahead = weights
    for i in range(steps):
        margins = signs * (rows @ ahead)
        slope = -2.0 * np.maximum(0.0, 1.0 - margins) if loss == "hinge" else -sigmoid(-margins)
        gradient = rows.T @ (share * slope * signs).astype(np.float32) + penalty * ahead
        following = ahead - np.float32(step) * gradient
        ahead = following + np.float32(i / (i + 3)) * (following - weights)
        weights = following
    return weights


def margins(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return rows @ weights[:-1] + weights[-1]


def calibrate(values: np.ndarray, signs: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities of sign +1 (Platt's method with smoothed targets).

    The slope is never negative, so a larger margin never means a lower probability.
    """
    above, below = (signs > 0).sum(), (signs < 0).sum()
    targets = np.where(signs > 0, (above + 1.0) / (above + 2.0), 1.0 / (below + 2.0))
    scale = float(np.abs(values).mean()) or 1.0
    x, slope, offset = values / scale, 1.0, 0.0
    for _ in range(steps):  # Newton steps on two parameters
        p = sigmoid(slope * x + offset)
        error, curve = p - targets, p * (1 - p) + 1e-9
        a, b, c = (curve * x * x).sum() + 1e-3, (curve * x).sum(), curve.sum() + 1e-3
        g, h = (error * x).sum(), error.sum()
        determinant = a * c - b * b
        slope -= np.clip((c * g - b * h) / determinant, -2, 2)
        offset -= np.clip((a * h - b * g) / determinant, -2, 2)
    return max(0.0, slope) / scale, offset


def fit_calibrated(rows: np.ndarray, signs: np.ndarray, loss: str) -> tuple[np.ndarray, float, float]:
    """Weights, and a calibration learned on every fourth row, from a fit on the others."""
    held = np.arange(len(rows)) % 4 == 3
    both = all(((signs > 0) == side)[part].any() for side in (True, False) for part in (held, ~held))
    weights = fit(rows, signs, loss)
    trial = fit(rows[~held], signs[~held], loss) if both else weights
    part = held if both else np.ones(len(rows), bool)
    return (weights, *calibrate(margins(rows[part], trial), signs[part]))
