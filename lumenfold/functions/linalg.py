"""Small dense kernels on the driver, NumPy only: everything here is D x D or C x D."""

from __future__ import annotations

import numpy as np

#: Eigenvalue floor of whitening, and the rank tolerance of the plain discriminant.
FLOOR, RANK_TOL = 1e-10, 1e-4


def canonical(w: np.ndarray) -> np.ndarray:
    """Columns flipped so that the entry of largest size is positive."""
    if not w.size:
        return w
    at = np.abs(w).argmax(axis=0)
    return w * np.where(w[at, np.arange(w.shape[1])] < 0, -1.0, 1.0)


def top_eigen(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors, largest first."""
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return values[::-1][:k], canonical(vectors[:, ::-1][:, :k])


def inverse_root(s: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return vectors / np.sqrt(np.maximum(values, floor))


def whitened(sb: np.ndarray, sw: np.ndarray, k: int, floor: float = FLOOR) -> np.ndarray:
    """Directions that maximise between against within scatter, with W' sw W = I."""
    a = inverse_root(sw, floor)
    return canonical(a @ top_eigen(a.T @ sb @ a, k)[1])


def shrink(s: np.ndarray, alpha: float) -> np.ndarray:
    """(1 - alpha) s + alpha tr(s) / d I."""
    d = len(s)
    mu = np.trace(s) / d
    return (1 - alpha) * s + alpha * (mu if mu > 0 else 1.0) * np.eye(d)


def ledoit_wolf(cov: np.ndarray, n: float, fourth: float) -> float:
    """Shrinkage intensity from the covariance (over n) of centred rows and the sum of their squared squared norms."""
    p = len(cov)
    if n <= 0:
        return 0.0
    mu, norm = np.trace(cov) / p, float((cov**2).sum())
    delta = (norm - p * mu**2) / p
    beta = min(delta, (fourth / n - norm) / (p * n))
    return 0.0 if beta <= 0 or delta <= 0 else float(beta / delta)


def orthonormal(w: np.ndarray) -> np.ndarray:
    return np.linalg.qr(w)[0]
