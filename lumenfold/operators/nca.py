"""Neighbourhood component analysis of a bounded sample: stochastic neighbours, maximised by limited-memory BFGS."""

from __future__ import annotations

import numpy as np

BLOCK = 1024


def objective(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(-expected number of rows whose drawn neighbour has their class, gradient by w), in blocks of rows."""
    z = x @ w
    sq = (z * z).sum(axis=1)
    value, grad = 0.0, np.zeros_like(w)
    for at in range(0, len(x), BLOCK):
        rows = np.arange(at, min(at + BLOCK, len(x)))
        d = sq[rows, None] + sq[None, :] - 2 * z[rows] @ z.T
        d[np.arange(len(rows)), rows] = np.inf
        p = np.exp(-(d - d.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        same = p * (y[rows, None] == y[None, :])
        hit = same.sum(axis=1)
        value += hit.sum()
        a = same - p * hit[:, None]
        # Sum of a_ij (x_i - x_j)(z_i - z_j)' without forming pairs.
        r, c = a.sum(axis=1), a.sum(axis=0)
        grad += (x[rows] * r[:, None]).T @ z[rows] + (x * c[:, None]).T @ z - x[rows].T @ (a @ z) - x.T @ (a.T @ z[rows])
    return -value, 2 * grad


def fit_nca(x: np.ndarray, y: np.ndarray, start: np.ndarray, max_iter: int, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    shape, w = start.shape, start.reshape(-1).copy()
    f, g = objective(x, y, w.reshape(shape))
    g = g.reshape(-1)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        q, alphas = g.copy(), []
        for s, t in reversed(past):
            a = (s @ q) / (s @ t)
            alphas.append(a)
            q -= a * t
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, t), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (t @ q) / (s @ t))
        slope, step = -(g @ q), 1.0
        if slope >= 0:
            break
        while step > 1e-10:
            f2, g2 = objective(x, y, (w - step * q).reshape(shape))
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, g2.reshape(-1) - g
        done = abs(f - f2) <= tol * max(1.0, abs(f))
        w, f, g = w + s, f2, g2.reshape(-1)
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        if done:
            break
    return w.reshape(shape)
