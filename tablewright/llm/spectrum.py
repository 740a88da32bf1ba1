"""The leading eigenpairs of a symmetric matrix by spectrum slicing.

A factorisation P(A - sI)P' = LDL' has as many positive entries in D as A has eigenvalues above s (Sylvester's law of
inertia).  Such counts halve an interval until it holds one eigenvalue, or a group that is equal to working precision.
Rayleigh quotient iteration then converges cubically to the pair, and counts on both sides of the result certify
its number.  The matrix has one row per dimension, so all of this is small whatever the number of vectors.
"""

from __future__ import annotations

import math

import numpy as np

ALPHA = (1 + math.sqrt(17)) / 8  # the bound on growth of diagonal pivoting
STEPS = 40


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive entries of D, with pivots of size one and two."""
    a = matrix - shift * np.eye(len(matrix))
    found, k, n = 0, 0, len(a)
    floor = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    while k < n:
        rest = a[k:, k:]
        column = np.abs(rest[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        largest = column[r - 1] if r else 0.0
        if max(abs(rest[0, 0]), largest) <= floor:  # an eigenvalue at the shift: it counts as below
            k += 1
            continue
        size = 1
        if abs(rest[0, 0]) < ALPHA * largest:
            row = np.abs(rest[r])
            row[r] = 0
            widest = row.max()
            if abs(rest[0, 0]) * widest >= ALPHA * largest * largest:
                pass
            elif abs(rest[r, r]) >= ALPHA * widest:
                _swap(rest, 0, r)
            else:
                size = 2
                _swap(rest, 1, r)
        if size == 1:
            pivot = rest[0, 0]
            found += pivot > 0
            rest[1:, 1:] -= np.outer(rest[1:, 0], rest[1:, 0] / pivot)
        else:
            block = rest[:2, :2]  # its determinant is negative by choice of the pivot
            found += 1
            rest[2:, 2:] -= rest[2:, :2] @ np.linalg.solve(block, rest[:2, 2:])
        k += size
    return found


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def _slices(matrix: np.ndarray, count: int, width: float) -> list[tuple[float, float, int, int]]:
    """(low, high, above high, above low) of disjoint intervals (low, high] from the top, that hold the ``count`` largest
    eigenvalues: one each, or several that differ by less than ``width``."""
    bound = np.abs(matrix).sum(1).max(initial=0.0) + width
    open_, out = [(-bound, bound, 0, len(matrix))], []
    while open_:
        low, high, over_high, over_low = open_.pop()
        if over_low == over_high or over_high >= count:
            continue
        middle = (low + high) / 2
        if over_low - over_high == 1 and high - low < 1e-2 * bound or high - low <= width or not low < middle < high:
            out.append((low, high, over_high, over_low))
            continue
        between = min(max(above(matrix, middle), over_high), over_low)
        open_ += [(low, middle, between, over_low), (middle, high, over_high, between)]  # the upper half comes next
    return out


def _without(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - others @ (others.T @ v)
    return v / np.linalg.norm(v)


def _pair(matrix: np.ndarray, low: float, high: float, others: np.ndarray, draw: np.random.Generator, width: float):
    """The pair with its eigenvalue in the interval, orthogonal to ``others``: inverse iteration from the middle until
    the quotient lies inside, then Rayleigh quotient iteration.  None if it leaves the interval."""
    n = len(matrix)
    v = _without(draw.standard_normal(n), others)
    shift = (low + high) / 2
    best = (math.inf, shift, v)
    for step in range(STEPS):
        try:
            y = np.linalg.solve(matrix - shift * np.eye(n), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(matrix - (shift + width / 8) * np.eye(n), v)
        v = _without(y, others)
        quotient = float(v @ matrix @ v)
        off = float(np.linalg.norm(matrix @ v - quotient * v))
        inside = low - width <= quotient <= high + width
        if inside and off < best[0]:
            best = (off, quotient, v)
        elif best[0] <= width:
            break
        if inside and (off < high - low or step > 3):
            shift = quotient
    return best[1:] if best[0] <= max(width, 1e-12 * abs(best[1])) else None


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    matrix = (matrix + matrix.T) / 2
    count = min(count, len(matrix))
    scale = np.abs(matrix).sum(1).max(initial=0.0)
    if scale == 0:
        return np.zeros(count), np.eye(len(matrix))[:, :count]
    matrix = matrix / scale
    width = 64 * np.finfo(float).eps * max(1, len(matrix)) ** 0.5
    draw = np.random.default_rng(0)
    values, vectors = [], np.empty((len(matrix), 0))
    work = _slices(matrix, count, width)[::-1]
    while work and len(values) < count:
        low, high, over_high, over_low = work.pop()
        own = []
        for _ in range(over_low - over_high):
            near = vectors[:, [i for i, e in enumerate(values) if e - high < 1e-3]]
            if (pair := _pair(matrix, low, high, near, draw, width)) is None:
                break
            own.append(pair[0])
            values.append(pair[0])
            vectors = np.column_stack([vectors, pair[1]])
        if len(own) < over_low - over_high:  # left the interval: drop what it gave and cut it again
            values, vectors = values[:len(values) - len(own)], vectors[:, :vectors.shape[1] - len(own)]
            middle = (low + high) / 2
            if not low < middle < high or high - low < width / 16:
                raise ArithmeticError("an eigenvalue could not be isolated")
            between = min(max(above(matrix, middle), over_high), over_low)
            work += [part for part in ((low, middle, between, over_low), (middle, high, over_high, between))
                     if part[2] < part[3]]
    order = np.argsort(-np.array(values), kind="stable")[:count]
    values, vectors = np.array(values)[order], vectors[:, order]
    _certify(matrix, values, 16 * width)
    return values * scale, vectors


def _certify(matrix: np.ndarray, values: np.ndarray, margin: float) -> None:
    """Counts around every group of values closer than the margin say that none is missing and none is double."""
    ends = [i for i in range(len(values)) if i + 1 == len(values) or values[i] - values[i + 1] > 4 * margin]
    first = 0
    for last in ends:
        if above(matrix, values[first] + margin) != first or above(matrix, values[last] - margin) < last + 1 or \
                last + 1 < len(values) and above(matrix, values[last] - margin) != last + 1:
            raise ArithmeticError("the numbering of eigenvalues does not agree with their counts")
        first = last + 1
