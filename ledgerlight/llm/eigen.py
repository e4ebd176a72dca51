"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST).

Inertia counts tell how many eigenvalues lie above a shift, so bisection finds the interval of the wanted ones and cuts
it into slices of a few. In a slice, complex shifted solves at quadrature points around it project a random block onto
the slice's eigenvectors; Rayleigh-Ritz extracts them, and the block is projected again until residuals are at rounding.
A slice must give as many pairs as its inertia counts say; else its block is widened, at last to the whole space.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SLICE_PAIRS = 4  # eigenvalues a slice should hold at most
POINTS = 8  # quadrature points on the upper half of a contour
ROUNDS = 12
_PIVOT = (1 + 17**0.5) / 8  # the usual bound of Bunch and Kaufman


class Slice(NamedTuple):
    low: float
    high: float
    count: int


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of a symmetric factorisation with pivots of one and two rows."""
    m = matrix - shift * np.eye(len(matrix))
    positive = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while len(m):
        pair = False
        if len(m) > 1:
            below = np.abs(m[1:, 0])
            r = int(below.argmax()) + 1
            largest = below[r - 1]
            if largest == 0 and m[0, 0] == 0:
                m = m[1:, 1:]
                continue
            if abs(m[0, 0]) < _PIVOT * largest:
                row = np.abs(m[r])
                row[r] = 0
                if abs(m[0, 0]) * row.max() < _PIVOT * largest**2:
                    pair = abs(m[r, r]) < _PIVOT * row.max()
                    swap(1 if pair else 0, r)
        elif m[0, 0] == 0:
            break
        if pair:  # such a pivot has one eigenvalue of either sign
            positive += 1
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
        else:
            positive += int(m[0, 0] > 0)
            m = m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:] / m[0, 0])
    return positive


def slices_of_largest(matrix: np.ndarray, wanted: int) -> list[Slice]:
    """Disjoint intervals that hold the ``wanted`` largest eigenvalues above rounding, and maybe a few more."""
    top = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    floor = len(matrix) * np.finfo(float).eps * top
    if not top:
        return []
    high, least = top * (1 + 1e-9), floor
    there = count_above(matrix, floor)
    wanted = min(wanted, there)
    upper = high
    while there > wanted and upper - least > 1e-12 * top:
        middle = (least + upper) / 2
        found = count_above(matrix, middle)
        if found >= wanted:
            least, there = middle, found
        else:
            upper = middle
    out, todo = [], [Slice(least, high, there)] if there else []
    while todo:
        s = todo.pop()
        if s.count <= SLICE_PAIRS or s.high - s.low <= 1e-10 * top:
            out.append(s)
            continue
        middle = (s.low + s.high) / 2
        above = count_above(matrix, middle) - count_above(matrix, s.high)
        todo += [h for h in (Slice(middle, s.high, above), Slice(s.low, middle, s.count - above)) if h.count]
    return sorted(out, reverse=True)


def solve_slice(matrix: np.ndarray, s: Slice, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The slice's eigenvalues and unit eigenvectors (columns), as many as its count."""
    size = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max())
    places, weights = np.polynomial.legendre.leggauss(POINTS)
    radius, centre = (s.high - s.low) / 2, (s.high + s.low) / 2
    turns = radius * np.exp(0.5j * np.pi * (1 - places))
    width = min(size, max(2 * s.count, s.count + 8))
    tolerance = 4 * np.finfo(float).eps * scale
    while True:
        block = np.random.default_rng(seed).standard_normal((size, width))
        best = None
        for _ in range(ROUNDS):
            if width < size:
                block = sum(w / 2 * (t * np.linalg.solve((centre + t) * np.eye(size) - matrix, block)).real
                            for w, t in zip(weights, turns))
            left, strength, _ = np.linalg.svd(block, full_matrices=False)
            basis = left[:, strength > strength[0] * 1e-14]
            values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ inner
            inside = (values > s.low) & (values <= s.high)
            rest = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            worst = float(rest.max()) if inside.any() else np.inf
            if int(inside.sum()) == s.count and (best is None or worst < best[0]):
                better = best is None or worst < 0.5 * best[0]
                best = (worst, values[inside], block[:, inside])
                if worst <= tolerance or (not better and worst <= 64 * tolerance):
                    break
            elif best is not None and best[0] <= 64 * tolerance:
                break
        if best is not None and best[0] <= 64 * tolerance:
            return best[1], best[2]
        if width == size:
            # All of the space: what misses the count by now lies on the edge of the slice within rounding.
            order = np.argsort(np.abs(values - np.clip(values, s.low, s.high)), kind="stable")[:s.count]
            return values[order], block[:, order]
        width = min(size, 2 * width)


def merge_slices(matrix: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their vectors: Rayleigh-Ritz over all slices, which also sets right angles between them.

    Inertia just above the least one must count as many as were found there.
    """
    if not pairs:
        return np.zeros(0), np.zeros((len(matrix), 0))
    basis, _ = np.linalg.qr(np.concatenate([v for _, v in pairs], axis=1))
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1], (basis @ inner)[:, ::-1]
    slack = len(matrix) * 1e-13 * abs(values[0])
    least = values[-1] + slack
    if count_above(matrix, least) != (values > least).sum() or count_above(matrix, least - 2 * slack) < len(values):
        raise ArithmeticError("eigenvalues were missed")
    values, vectors = values[:wanted], vectors[:, :wanted]
    strongest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(strongest < 0, -1.0, 1.0)
