"""Eigenvectors of a symmetric matrix by spectral divide and conquer with QDWH polar factors.

The polar factor U of A - sI has the eigenvectors of A and the eigenvalues -1 and 1, so
(I + U) / 2 projects on the invariant subspace of the eigenvalues above s. An orthonormal basis
of it and of its complement splits A into two smaller problems, down to single components. U comes
by QDWH: dynamically weighted Halley iterations, by QR while the smallest singular value is
small and by Cholesky afterwards, at most seven for double precision.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Rounds after which QDWH has converged for any matrix of double precision.
ROUNDS = 30


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix that is not zero."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = max(_smallest(x), EPS / 16)
    for _ in range(ROUNDS):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            upper, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
            x = q / r * x + (p - q / r) / np.sqrt(r) * upper[:n] @ upper[n:].T
        else:
            z = np.linalg.cholesky(np.eye(n) + r * x.T @ x)
            x = q / r * x + (p - q / r) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        x = (x + x.T) / 2
        low = min(low * (p + q * low**2) / (1 + r * low**2), 1.0)
        if 1 - low < 10 * EPS and np.linalg.norm(x - before) <= np.cbrt(5 * EPS):
            break
    return x


def _smallest(x: np.ndarray) -> float:
    """A lower bound of the smallest singular value, 0 for a singular matrix."""
    try:
        return 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return 0.0


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below the shift, if both are there and are invariant."""
    n = len(a)
    projector = (np.eye(n) + polar(a - shift * np.eye(n))) / 2
    above = int(round(np.trace(projector)))
    if not 0 < above < n:
        return None
    # Two steps of subspace iteration; a projector needs one, the second mends rounding.
    basis = np.random.default_rng(n).standard_normal((n, above))
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        high, low = basis[:, :above], basis[:, above:]
        basis = high
    coupled = np.linalg.norm(high.T @ a @ low)
    return (high, low) if coupled <= 100 * n * EPS * np.linalg.norm(a) else None


def _shifts(a: np.ndarray) -> list[float]:
    """Places to split at: the median of the diagonal, then the mean of the eigenvalues, which
    lies between the least and the largest, and places about it."""
    mean = np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    return [float(np.median(np.diag(a))), mean, *(mean + k * spread / 16 for k in (1, -1, 3, -3, 7, -7))]


def _vectors(a: np.ndarray, scale: float) -> np.ndarray:
    n = len(a)
    spread = a - np.trace(a) / n * np.eye(n)
    # Equal eigenvalues: every basis of this subspace is one of eigenvectors.
    if n == 1 or np.linalg.norm(spread) <= n * EPS * scale:
        return np.eye(n)
    for shift in _shifts(a):
        if found := _split(a, shift):
            parts = [basis @ _vectors(_even(basis.T @ a @ basis), scale) for basis in found]
            return np.hstack(parts)
    raise ArithmeticError("No shift splits the spectrum.")


def _even(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, largest entry positive."""
    a = _even(np.asarray(a, dtype=np.float64))
    if not a.size:
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    # Scaled, so that squares neither pass the largest number nor vanish.
    a = a / size
    vectors = _vectors(a, np.linalg.norm(a))
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order] * size, vectors[:, order]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[lead, np.arange(len(a))])
