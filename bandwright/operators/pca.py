"""Principal components of a band matrix."""

from __future__ import annotations

import numpy as np

from ..errors import InvalidArgs


def pca(cov: np.ndarray, n_dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, W): the n_dims largest eigenvalues in descending order, and their eigenvectors as rows of W.

    Signs are fixed: the entry of largest magnitude is positive.  W is a transform for linear_transform.
    """
    cov = np.asarray(cov, np.float64)
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1] or not np.isfinite(cov).all():
        raise InvalidArgs("PCA needs a finite square matrix")
    k = len(cov) if n_dims is None else n_dims
    if not 1 <= k <= len(cov):
        raise InvalidArgs(f"{k} dimensions of {len(cov)}")
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    w = vectors.T[::-1][:k]
    sign = np.sign(w[np.arange(k), np.abs(w).argmax(1)])
    return values[::-1][:k], w * sign[:, None]


def explained(values: np.ndarray) -> np.ndarray:
    """The share of the total that each eigenvalue is."""
    return values / values.sum()
