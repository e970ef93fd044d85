"""Small regression fits shared by the classifiers; they run on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised weights by Newton steps with halving; the last column is the unpenalised intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9

    def loss(v):
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * v * v))

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        then = loss(w)
        if now - then < 1e-9 * max(1.0, abs(now)):
            break
        now = then
    return w


def lbfgs(loss_and_gradient, start: np.ndarray, rounds: int = 200, memory: int = 8) -> np.ndarray:
    """Minimise a smooth function by limited-memory BFGS with backtracking."""
    x = start.copy()
    loss, g = loss_and_gradient(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        if slope > -1e-10:
            break
        size = 1.0 if past else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        while True:
            then, h = loss_and_gradient(x + size * d)
            if then <= loss + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = size * d, h - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, g = x + s, h
        if loss - then < 1e-9 * max(1.0, abs(loss)):
            break
        loss = then
    return x
