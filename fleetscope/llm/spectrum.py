"""Largest eigenvalues of a symmetric matrix by contour integration (FEAST), with inertia counts that verify them. The matrix is as wide as a vector."""

from __future__ import annotations

import numpy as np

_NODES = 8
_EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a, n = np.array(matrix, float), len(matrix)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.sqrt(x @ x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.sqrt(x @ x)
        block = a[k + 1:, k + 1:]
        p = block @ x
        p -= (x @ p) * x
        block -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy() ** 2


def count_above(diagonal: np.ndarray, squares: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of the shifted matrix's factorisation, by the law of inertia."""
    count, pivot, least = 0, 1.0, _EPS * _EPS * (np.abs(diagonal).max(initial=0.0) + np.sqrt(squares.max(initial=0.0)) + abs(shift)) + 1e-300
    for a, b2 in zip(diagonal.tolist(), [0.0, *squares.tolist()]):
        pivot = a - shift - b2 / pivot
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def project(matrix: np.ndarray, low: float, high: float, start: np.ndarray) -> np.ndarray:
    """The spectral projector on the interval applied to ``start``: Gauss-Legendre quadrature of (z - matrix)^-1 over the upper half circle
    through ``low`` and ``high``; the lower half is its conjugate."""
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(_NODES)
    total, one = np.zeros_like(start), np.eye(len(matrix))
    for node, weight in zip(nodes, weights):
        turn = np.exp(0.5j * np.pi * (1 + node))
        total += weight / 2 * (radius * turn * np.linalg.solve((centre + radius * turn) * one - matrix, start.astype(complex))).real
    return total


def eigenpairs_within(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues in the interval, falling, and their unit vectors as columns. ``count`` is what inertia says; a result that holds
    fewer or more, or is not exact to rounding, stops the job."""
    n, size = len(matrix), np.abs(matrix).sum(axis=1).max()
    width = min(n, count + max(4, count // 2))
    random = np.random.Generator(np.random.PCG64(13))
    basis = random.standard_normal((n, width))
    best = None
    for step in range(rounds):
        basis = np.linalg.qr(project(matrix, low, high, basis))[0]
        values, vectors = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ vectors
        inside = (values > low) & (values < high)
        if inside.sum() == count:
            found, own = values[inside][::-1], basis[:, inside][:, ::-1]
            worst = np.sqrt(((matrix @ own - own * found) ** 2).sum(axis=0)).max()
            if best is not None and worst >= best[0] / 2 and best[0] <= 1e3 * _EPS * size:
                break
            if best is None or worst < best[0]:
                best = (worst, found, own)
        elif step % 10 == 9 and width < n:  # a start without a part along some eigenvector
            width = min(n, 2 * width)
            basis = random.standard_normal((n, width))
    if best is None or best[0] > 1e4 * _EPS * size:
        raise ArithmeticError(f"the contour from {low} to {high} did not yield its {count} eigenpairs")
    return best[1], best[2]


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns; fewer if the others are zero to rounding.

    Inertia counts by bisection locate the eigenvalues, and the gaps between them: eigenvalues closer than a thousandth share an interval. A
    contour around each interval, half a gap away from the neighbours, gives its eigenpairs, as many as the inertia counts say.
    """
    n = len(matrix)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(matrix).sum(axis=1).max())
    if scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    matrix = matrix / scale  # eigenvalues up to 1
    diagonal, squares = tridiagonal(matrix)
    zero = 4 * n * _EPS
    present = count_above(diagonal, squares, zero)

    def located(rank: int) -> float:
        low, high = zero, 1.0 + zero
        while high - low > 1e-9 * high:
            middle = (low + high) / 2
            if count_above(diagonal, squares, middle) >= rank:
                low = middle
            else:
                high = middle
        return (low + high) / 2

    values, vectors, places, at = [], [], [2.0], 0
    while at < min(wanted, present):
        if len(places) < at + 2:
            places.append(located(at + 1))
        end = at + 1
        while True:  # the eigenvalues up to rank ``end`` belong together while the next is near
            if len(places) < end + 2:
                places.append(located(end + 1) if end < present else 0.0)
            if end >= present or places[end] - places[end + 1] > 1e-3 * places[end]:
                break
            end += 1
        margin = min(places[at] - places[at + 1], places[end] - places[end + 1], places[at + 1]) / 2
        low, high = places[end] - margin, places[at + 1] + margin
        count = count_above(diagonal, squares, low) - count_above(diagonal, squares, high)
        if count != end - at:
            raise ArithmeticError(f"inertia counts {count} eigenvalues where {end - at} were located")
        found, own = eigenpairs_within(matrix, low, high, count)
        values.append(found)
        vectors.append(own)
        at = end
    if not values:
        return np.zeros(0), np.zeros((n, 0))
    values, vectors = np.concatenate(values)[:wanted], np.concatenate(vectors, axis=1)[:, :wanted]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values * scale, vectors
