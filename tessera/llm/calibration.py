"""Scores turned into probabilities by a logistic curve fitted on held-out rows."""

from __future__ import annotations

import numpy as np


def logistic(score: np.ndarray, truth: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from scores to probabilities, by Newton steps halved until they descend; truths
    are smoothed so that none is certain."""
    n1, n0 = truth.sum(), len(truth) - truth.sum()
    y = np.where(truth > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([score, np.ones(len(score))], axis=1), np.zeros(2)
    loss = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - y))
        while loss(w - move) > loss(w) and np.abs(move).max() > 1e-9:
            move = move / 2
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
