"""Leading eigenpairs of one symmetric matrix: Householder, Sturm counts, inverse iteration.

The matrix is a covariance over vector components: its size is that of one
vector squared, whatever the number of rows it was summed from.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Eigenvalues closer than this part of the matrix norm are one cluster.
CLUSTER = 1e-3
INVERSE_STEPS = 4


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit Householder vectors that brought the matrix there."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        v = x / size if size else x
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        norm = np.linalg.norm(v)
        v = v / norm if size and norm else np.zeros_like(v)
        mirrors.append(v)
        # P A P with P = I - 2 v v', as a symmetric update of rank two.
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = 2 * (p - v * (v @ p))
        rest -= np.outer(v, q) + np.outer(q, v)
        a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
    return a.diagonal().copy(), a.diagonal(1).copy(), mirrors


def mirrored(vector: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix's space in that of the matrix it was made from."""
    out = np.array(vector, float)
    for k in range(len(mirrors) - 1, -1, -1):
        tail = out[k + 1 :]
        tail -= 2 * mirrors[k] * (mirrors[k] @ tail)
    return out


def count_below(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvalues below each of ``values``: sign changes of the Sturm sequence."""
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny / EPS**2)
    pivot = np.full(len(values), np.inf)
    below = np.zeros(len(values), int)
    squares = np.concatenate([[0.0], off * off])
    for d, b in zip(diagonal, squares):
        pivot = d - values - b / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection of Sturm counts."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    spread = EPS * n * (np.abs(diagonal) + reach).max()
    low = np.full(count, (diagonal - reach).min() - spread)
    high = np.full(count, (diagonal + reach).max() + spread)
    wanted = n - np.arange(count)  # the i-th largest has this many at or below it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        under = count_below(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float):
    """``solve(x)`` for the tridiagonal matrix less ``value``, by elimination with row exchanges."""
    n = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny / EPS)
    rows = []  # pivot row: three entries; then the factor and whether rows changed places
    d, u, w = diagonal[0] - value, off[0] if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        below, next_d, next_u = off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0
        if abs(d) >= abs(below):
            d = d if abs(d) > tiny else tiny
            factor = below / d
            rows.append((d, u, w, factor, False))
            d, u, w = next_d - factor * u, next_u - factor * w, 0.0
        else:
            factor = d / below
            rows.append((below, next_d, next_u, factor, True))
            d, u, w = u - factor * next_d, w - factor * next_u, 0.0
    rows.append((d if abs(d) > tiny else tiny, 0.0, 0.0, 0.0, False))

    def solve(x: np.ndarray) -> np.ndarray:
        y = x.tolist()
        for i in range(n - 1):
            if rows[i][4]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= rows[i][3] * y[i]
        for i in range(n - 1, -1, -1):
            d, u, w = rows[i][:3]
            rest = y[i] - (u * y[i + 1] if i + 1 < n else 0.0) - (w * y[i + 2] if i + 2 < n else 0.0)
            y[i] = rest / d
            if abs(y[i]) > 1e150:  # grown by a tiny pivot; only the direction counts
                y = [v * 1e-150 for v in y]
        return np.array(y)

    return solve


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as rows.

    Inverse iteration starts from fixed pseudo-random vectors. Within a cluster
    of close eigenvalues every iterate is made orthogonal to the vectors before
    it, so that repeated eigenvalues give an orthonormal basis of their space.
    """
    n = len(matrix)
    count = min(count, n)
    size = float(np.abs(matrix).max(initial=0.0))
    if not count or not size:
        return np.zeros(count), np.eye(n)[:count]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    values = leading_values(diagonal, off, count)
    rng = np.random.default_rng(n)
    vectors: list[np.ndarray] = []
    first = 0  # of the current cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        # Equal values are moved apart a little, so that their systems differ.
        solve = _solver(diagonal, off, value - (i - first) * EPS * norm)
        x = rng.uniform(-1, 1, n)
        for _ in range(INVERSE_STEPS):
            x = _apart(solve(_apart(x, vectors[first:])), vectors[first:])
        vectors.append(x)
    return values * size, np.array([mirrored(v, mirrors) for v in vectors])


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``x`` as a unit vector orthogonal to ``others``; twice, as the first pass leaves rounding."""
    x = x / np.abs(x).max()
    for _ in range(2):
        for other in others:
            x = x - other * (other @ x)
        x = x / np.linalg.norm(x)
    return x
