"""Small dense models that the classifiers share."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


class Logistic:
    """Ridge logistic regression over standardized columns, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        x = np.asarray(x, float)
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where((s := x.std(0) if len(x) else np.zeros(x.shape[1])) > 1e-9, s, 1.0)
        a = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(a.shape[1])
        keep = np.full(a.shape[1], ridge)
        keep[0] = 1e-3
        for _ in range(steps if len(x) else 0):
            p = sigmoid(a @ w)
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((np.asarray(x, float) - self.mean) / self.scale, -20, 20)
        return np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)
