"""Small dense least squares."""

from __future__ import annotations

import numpy as np


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least-norm solution of the normal equations; columns are scaled first so that size does not decide rank."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    real = values > values.max(initial=0.0) * 1e-11
    basis, rest = vectors[:, real] / scale[:, None], vectors[:, ~real] / scale[:, None]
    beta = basis @ ((basis.T @ right) / values[real])
    beta += basis @ ((basis.T @ (right - gram @ beta)) / values[real])  # one step of refinement
    dead = np.diag(gram) <= 0
    beta[dead] = 0.0
    if rest.shape[1]:
        null, _ = np.linalg.qr(rest)
        beta -= null @ (null.T @ beta)
    beta[dead] = 0.0
    return beta
