"""Linear classifiers by dual coordinate descent, and hashed n-grams to feed them."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_buckets(points: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """A bucket for each character n-gram of 1 to ``longest`` characters."""
    found, total = [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for width in range(1, min(longest, len(points)) + 1):
            size = len(points) - width + 1
            total = (total[:size] + points[width - 1 :] + np.uint64(width)) * BASE
            found.append(((total ^ (total >> np.uint64(29))) * BASE) >> np.uint64(64 - bits))
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]],
    signs: np.ndarray,
    size: int,
    cost: float = 1.0,
    epochs: int = 20,
    seed: int = 7,
) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss classifier; the last one is the bias.

    Each row is (columns, values).  One dual variable at a time moves to its optimum
    within [0, cost], the costs of a class growing as it gets rarer.
    """
    weights = np.zeros(size + 1)
    share = np.where(signs > 0, np.mean(signs > 0), np.mean(signs < 0))
    limits = cost * 0.5 / np.maximum(share, 1e-9)
    alphas = np.zeros(len(rows))
    squares = np.array([float(values @ values) + 1.0 for _, values in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            columns, values = rows[i]
            margin = weights[columns] @ values + weights[size]
            new = min(max(alphas[i] - (signs[i] * margin - 1) / squares[i], 0.0), limits[i])
            if new != alphas[i]:
                step = (new - alphas[i]) * signs[i]
                weights[columns] += step * values
                weights[size] += step
                moved = max(moved, abs(new - alphas[i]))
                alphas[i] = new
        if moved < 1e-3:
            break
    return weights


def logistic_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Slopes and intercept that turn margins (one row each) into probabilities."""
    x = np.column_stack([margins, np.ones(len(labels))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(slope, x.T @ (labels - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def probability(value: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))
