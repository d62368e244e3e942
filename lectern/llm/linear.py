"""Linear support vector machines fitted by dual coordinate descent (Hsieh et al., 2008)."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, c: float = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights that minimise half their square plus c times the hinge loss over sparse rows (indices, values).

    labels are +1 and -1; a class's costs are scaled so that both weigh the same.
    """
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    cost = c * np.where(labels > 0, len(labels) / max(1, 2 * (labels > 0).sum()), len(labels) / max(1, 2 * (labels < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            at, values = rows[i]
            gradient = labels[i] * float(w[at] @ values) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * labels[i] * values
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a m + b))) through labels at their margins, both classes weighed alike."""
    a, b = 1.0, 0.0
    target = np.where(labels > 0, 0.98, 0.02)
    weight = np.where(labels > 0, 1 / max(1, (labels > 0).sum()), 1 / max(1, (labels < 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.0)), float(b)
