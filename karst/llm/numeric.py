"""Small numeric tools for models that are fitted on bounded samples on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100) -> np.ndarray:
    """L-BFGS with a backtracking line search; f gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += (a - y @ q / (y @ s)) * s
        slope = -(q @ grad)
        if slope > -1e-12:
            break
        step = 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
        while step > 1e-10:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        done = abs(value - new_value) <= 1e-9 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        if done:
            break
    return x


def fit_logistic(features: np.ndarray, labels: np.ndarray, l2: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression; the last one is the bias, which isn't shrunk."""
    x = np.hstack([features, np.ones((len(features), 1))])
    y, w = labels.astype(float), np.ones(len(labels)) if weights is None else weights
    shrink = np.full(x.shape[1], l2)
    shrink[-1] = 0

    def loss(theta):
        z = x @ theta
        value = (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * theta**2).sum()
        return value, x.T @ (w * (sigmoid(z) - y)) + shrink * theta

    return minimize(loss, np.zeros(x.shape[1]))


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z)))
