"""Small numpy logistic regression shared by the classifiers: fit on a bounded sample, one column per target."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


def fit_sparse(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, weight: np.ndarray, dim: int,
               steps: int = 80, rate: float = 0.4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on rows of a compressed sparse matrix; ``weight`` sums to one; deterministic."""
    rows = np.repeat(np.arange(len(y)), np.diff(ptr))
    w, b = np.zeros(dim), 0.0
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[idx] * val, minlength=len(y)) + b
        r = (sigmoid(z) - y) * weight
        g, gb = np.bincount(idx, weights=val * r[rows], minlength=dim) + l2 * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= a * m / (np.sqrt(v) + 1e-8)
        b -= a * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.3, l2: float = 1e-4):
    """As ``fit_sparse`` for a dense matrix and several 0/1 target columns at once; returns (weights, biases)."""
    x = x.astype(np.float32, copy=False)
    y = y.astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    b = np.zeros(y.shape[1], dtype=np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        r = (sigmoid(x @ w + b).astype(np.float32) - y) / len(x)
        g, gb = x.T @ r + l2 * w, r.sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= (a * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        b -= (a * mb / (np.sqrt(vb) + 1e-8)).astype(np.float32)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt calibration p = sigmoid(a z + c): Newton steps on smoothed targets, rows weighted by ``weight``."""
    if len(z) == 0:
        return 1.0, 0.0
    pos, neg = (y > 0.5).sum(), (y < 0.5).sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = weight / weight.sum()
    a, c = 0.0, float(np.log((weight @ t) / max(1e-9, 1 - weight @ t)))
    for _ in range(60):
        p = sigmoid(a * z + c)
        g = np.array([weight @ ((p - t) * z), weight @ (p - t)])
        h = weight * np.maximum(p * (1 - p), 1e-9)
        k = np.array([[h @ (z * z) + 1e-9, h @ z], [h @ z, h.sum() + 1e-9]])
        d = np.linalg.solve(k, g)
        d *= min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(c)
