"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection on Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, and the Householder reflections."""
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    reflections = []
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0.0:
            reflections.append((x, 0.0))
            continue
        scale = max(scale, abs(x[0]))
        v = x / scale
        alpha = -np.copysign(np.sqrt(v @ v), v[0])
        v[0] -= alpha
        beta = 2.0 / (v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = beta * (rest @ v)
        w = p - (0.5 * beta * (p @ v)) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = 0.0
        a[k + 1, k] = alpha * scale
        reflections.append((v, beta))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def _back(vectors: np.ndarray, reflections: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Columns in the basis of the tridiagonal matrix, turned back to that of the full one."""
    for k in reversed(range(len(reflections))):
        v, beta = reflections[k]
        if beta:
            part = vectors[k + 1 :]
            part -= np.outer(beta * v, v @ part)
    return vectors


def count_below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point: the negative terms of its Sturm sequence."""
    tiny = np.finfo(np.float64).tiny
    squares = off * off
    floor = max(tiny, EPS * EPS * (squares.max() if len(squares) else 0.0))
    counts = np.zeros(len(points), dtype=np.int64)
    pivot = np.ones(len(points))
    for i, d in enumerate(diagonal):
        pivot = d - points - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        counts += pivot < 0.0
    return counts


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues of the tridiagonal matrix, falling; all are bisected at once."""
    size = len(diagonal)
    reach = np.zeros(size)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    pad = EPS * size * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    lows, highs = np.full(count, low - pad), np.full(count, high + pad)
    wanted = size - 1 - np.arange(count)  # as many eigenvalues lie below the one looked for
    for _ in range(2000):
        middle = lows + (highs - lows) * 0.5
        open_ = (middle > lows) & (middle < highs)
        if not open_.any():
            break
        below = count_below(diagonal, off, middle) > wanted
        highs = np.where(below & open_, middle, highs)
        lows = np.where(~below & open_, middle, lows)
    return lows + (highs - lows) * 0.5


class _Shifted:
    """LU factors of a shifted tridiagonal matrix with row exchanges; zero pivots become tiny ones."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float, norm: float) -> None:
        size = len(diagonal)
        self.main, self.above, self.second = diagonal - shift, np.append(off, 0.0), np.zeros(size)
        self.factor, self.swapped = np.zeros(max(size - 1, 0)), np.zeros(max(size - 1, 0), dtype=bool)
        small = EPS * norm or 1.0
        main, above, second = self.main, self.above, self.second
        for i in range(size - 1):
            lower = off[i]
            if abs(lower) > abs(main[i]):
                self.swapped[i] = True
                self.factor[i] = main[i] / lower
                next_main, next_above = main[i + 1], above[i + 1]
                held = above[i]
                main[i], above[i], second[i] = lower, next_main, next_above
                main[i + 1] = held - self.factor[i] * next_main
                above[i + 1] = -self.factor[i] * next_above
            else:
                if abs(main[i]) < small:
                    main[i] = np.copysign(small, main[i])
                self.factor[i] = lower / main[i]
                main[i + 1] -= self.factor[i] * above[i]
        if abs(main[-1]) < small:
            main[-1] = np.copysign(small, main[-1])

    def solve(self, x: np.ndarray) -> np.ndarray:
        x, size = x.copy(), len(x)
        for i in range(size - 1):
            if self.swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - self.factor[i] * x[i + 1]
            else:
                x[i + 1] -= self.factor[i] * x[i]
        for i in reversed(range(size)):
            if i + 2 < size:
                x[i] -= self.second[i] * x[i + 2]
            if i + 1 < size:
                x[i] -= self.above[i] * x[i + 1]
            x[i] /= self.main[i]
            if abs(x[i]) > 1e150:  # the direction is all that counts
                x *= 1e-150
        return x


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Eigenvalues that lie close together (within a thousandth of the matrix's norm) form a cluster, within which every
    iterate is orthogonalised twice against the vectors already found.
    """
    size = len(matrix)
    count = min(count, size)
    scale = np.abs(matrix).max() if size else 0.0
    if scale == 0.0:
        return np.zeros(count), np.eye(size)[:, :count]
    diagonal, off, reflections = tridiagonalise(np.asarray(matrix, dtype=np.float64) / scale)
    values = leading_values(diagonal, off, count)
    norm = float((np.abs(diagonal) + np.append(np.abs(off), 0.0) + np.append(0.0, np.abs(off))).max())
    vectors = np.zeros((size, count))
    rng = np.random.default_rng(20)
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # Equal shifts would give the same factors: step down by a few roundings within a cluster.
        shift = value if k == first else min(value, shift - 4 * EPS * norm)
        factors = _Shifted(diagonal, off, shift, norm)
        near = vectors[:, first:k]
        x = rng.standard_normal(size)
        best = np.inf
        for _ in range(12):
            x -= near @ (near.T @ x)
            x = factors.solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
            image = diagonal * x
            image[:-1] += off * x[1:]
            image[1:] += off * x[:-1]
            error = np.linalg.norm(image - value * x)
            if error >= best / 2 and best <= 64 * EPS * size * norm:
                break
            best = min(best, error)
        vectors[:, k] = x
    return values * scale, _back(vectors, reflections)
