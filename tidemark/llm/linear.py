"""Small linear models, fitted with numpy on a bounded number of rows: a sample, or one part of all rows after another."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def svm(columns: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, c: float = 10.0, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent; y is +1 or -1.

    A row is the columns in which it has values, and those. Give each a constant column for a bias."""
    n, rng = len(y), np.random.default_rng(seed)
    w, alpha = np.zeros(width, np.float64), np.zeros(n)
    extra = 1.0 / (2 * c)
    diagonal = np.array([v @ v for v in values]) + extra
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, v = columns[i], values[i]
            g = y[i] * float(w[at] @ v) - 1 + extra * alpha[i]
            new = max(alpha[i] - g / diagonal[i], 0.0)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def logistic(
    x: np.ndarray, y: np.ndarray, l2: float = 1e-3, changes: list[tuple[list[int], list[int], int]] | None = None, pull: float = 0.0, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression. changes: columns that go from 1 to 0, columns that go from 0 to 1, how
    often; they should leave a score as it is.

    The loss is the mean log loss + l2 |w|^2 + pull times the mean squared difference of the logit over the changes.
    Minimised by gradient steps with momentum, of a size that the curvature's bound allows."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    if not n:
        return w, b
    changes = changes or []
    row = np.repeat(np.arange(len(changes)), [len(g) + len(c) for g, c, _ in changes])
    column = np.array([i for g, c, _ in changes for i in [*g, *c]], np.int64)
    sign = np.array([v for g, c, _ in changes for v in [-1.0] * len(g) + [1.0] * len(c)])
    share = np.array([k for _, _, k in changes], float)
    share /= max(share.sum(), 1.0)

    def pulled(v: np.ndarray) -> np.ndarray:
        moved = np.bincount(row, sign * v[column], minlength=len(changes))
        return np.bincount(column, sign * (share * moved)[row], minlength=d)

    steep = 0.0
    if len(changes):  # the largest curvature of the penalty, by power iteration, with some room
        v = np.random.default_rng(0).normal(size=d)
        for _ in range(50):
            v = pulled(v)
            steep = float(np.linalg.norm(v))
            if not steep:
                break
            v /= steep
    bound = 0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1) + 2 * l2 + 2.4 * pull * steep
    v, u, t = w, b, 1.0
    for _ in range(rounds):
        e = sigmoid(x @ v + u) - y
        g = x.T @ e / n + 2 * l2 * v
        if len(changes):
            g = g + 2 * pull * pulled(v)
        new_w, new_b, new_t = v - g / bound, u - e.mean() / bound, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)
