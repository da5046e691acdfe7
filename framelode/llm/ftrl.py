"""Sparse multinomial logistic regression, trained with follow-the-regularised-leader and elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (feature, value) pairs in compressed form."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def part(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, values and row numbers of some rows."""
        at = np.concatenate([np.arange(self.ends[r] - self.sizes[r], self.ends[r]) for r in which])
        return self.index[at], self.value[at], np.repeat(np.arange(len(which)), self.sizes[which])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(group, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1)


def scores(weights: np.ndarray, x: Sparse, batch: int = 4096) -> np.ndarray:
    """Logits of all rows."""
    out = np.zeros((len(x.sizes), weights.shape[1]))
    for a in range(0, len(x.sizes), batch):
        which = np.arange(a, min(a + batch, len(x.sizes)))
        i, v, r = x.part(which)
        out[which] = _sums(r, weights[i] * v[:, None], len(which))
    return out


def fit(x: Sparse, y: np.ndarray, features: int, classes: int, *, epochs: int = 4, batch: int = 128, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Weights (features x classes); most are exactly 0. Deterministic for given rows."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            which = order[a : a + batch]
            i, v, r = x.part(which)
            used, at = np.unique(i, return_inverse=True)
            zu, nu = z[used], n[used]
            w = weights(zu, nu)
            p = softmax(_sums(r, w[at] * v[:, None], len(which)))
            p[np.arange(len(which)), y[which]] -= 1
            g = _sums(at, v[:, None] * p[r], len(used)) / len(which) * 16
            z[used] = zu + g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * w
            n[used] = nu + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which held-out rows are most likely; at least 0.3, as rows without any error would ask for none at all."""
    grid = np.exp(np.linspace(np.log(0.3), np.log(20), 121))
    rows = np.arange(len(y))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
