"""Small dense logistic regression for bounded samples."""

from __future__ import annotations

import copy

import numpy as np


#: The largest that p (1 - p) can be.
CURVATURE = 0.25


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """L2-regularised logistic regression on standardised columns, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 25) -> None:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1
        z = self.design(x)
        w = np.ones(len(y)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = sigmoid(z @ self.w)
            g = z.T @ (w * (p - y)) + ridge * self.w
            h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def stepped(self, x: np.ndarray, y: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l2: float = 1.0) -> Logistic:
        """One step further on these rows and others, of which only gradient and a bound of the Hessian are given.

        The bound takes CURVATURE for every row, so a step never overshoots, even where the rows are all but decided.
        """
        z = self.design(x)
        p = sigmoid(z @ self.w)
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-3
        g = z.T @ (p - y) + ridge * self.w + gradient
        h = CURVATURE * z.T @ z + np.diag(ridge) + hessian
        new = copy.copy(self)
        new.w = self.w - np.linalg.solve(h, g)
        return new

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))
