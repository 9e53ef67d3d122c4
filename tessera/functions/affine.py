"""Affine algebra as column expressions over row-major homogeneous ARRAY<DOUBLE> matrices."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(a: Column, n: int, i: int, j: int) -> Column:
    return F.get(a, F.lit(i * (n + 1) + j))


def _sum(terms: list[Column]) -> Column:
    return reduce(add, terms)


def literal(values) -> Column:
    """An array of doubles."""
    return F.array(*(F.lit(float(v)) for v in values))


def identity(n: int) -> Column:
    return literal(float(i == j) for i in range(n + 1) for j in range(n + 1))


def translation(offsets: list[Column], n: int | None = None) -> Column:
    """The identity with ``offsets`` in its last column."""
    n = n or len(offsets)
    return F.array(*((offsets[i].cast("double") if j == n and i < n else F.lit(float(i == j))) for i in range(n + 1) for j in range(n + 1)))


def translation_of(a: Column, n: int) -> Column:
    """The last column of an affine."""
    return F.array(*(_at(a, n, i, n) for i in range(n)))


def linear_of(a: Column, n: int) -> Column:
    """The n x n part of an affine, row by row."""
    return F.array(*(_at(a, n, i, j) for i in range(n) for j in range(n)))


def from_linear(linear: Column, shift: Column, n: int) -> Column:
    """An affine from its n x n part and its translation."""
    last = [F.lit(0.0)] * n + [F.lit(1.0)]
    rows = [c for i in range(n) for c in [*(F.get(linear, F.lit(i * n + j)) for j in range(n)), F.get(shift, F.lit(i))]]
    return F.array(*rows, *last)


def rotation_2d(angle: Column, point: tuple[Column, Column] | None = None) -> Column:
    """Rotation by ``angle`` in the (y, x) plane about ``point`` or the origin."""
    c, s = F.cos(angle), F.sin(angle)
    py, px = point or (F.lit(0.0), F.lit(0.0))
    return F.array(c, -s, py - c * py + s * px, s, c, px - s * py - c * px, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def rotation_3d(angle: float, axis: tuple[float, float, float]) -> list[float]:
    """Rotation matrix about an axis (z, y, x order), as 16 numbers."""
    norm = math.sqrt(sum(a * a for a in axis))
    u = [a / norm for a in axis]
    c, s = math.cos(angle), math.sin(angle)
    cross = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    rows = [[c * (i == j) + s * cross[i][j] + (1 - c) * u[i] * u[j] for j in range(3)] + [0.0] for i in range(3)]
    return [v for row in rows for v in row] + [0.0, 0.0, 0.0, 1.0]


def apply(a: Column, p: Column, n: int) -> Column:
    """A affine of a point: A @ [p, 1]."""
    return F.array(*(_sum([_at(a, n, i, j) * F.get(p, F.lit(j)) for j in range(n)]) + _at(a, n, i, n) for i in range(n)))


def multiply(a: Column, b: Column, n: int) -> Column:
    """A @ B."""
    return F.array(*(_sum([_at(a, n, i, k) * _at(b, n, k, j) for k in range(n + 1)]) for i in range(n + 1) for j in range(n + 1)))


def determinant(a: Column, n: int) -> Column:
    """Determinant of the linear part, for 2 or 3 dimensions."""
    m = lambda i, j: _at(a, n, i, j)
    if n == 2:
        return m(0, 0) * m(1, 1) - m(0, 1) * m(1, 0)
    return m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))


def invert(a: Column, n: int) -> Column:
    """Inverse of an affine in closed form, for 2 or 3 dimensions; null where it is singular."""
    m, det = (lambda i, j: _at(a, n, i, j)), F.nullif(determinant(a, n), F.lit(0.0))
    if n == 2:
        inv = [[m(1, 1) / det, -m(0, 1) / det], [-m(1, 0) / det, m(0, 0) / det]]
    else:
        minor = lambda i, j: m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
        inv = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    rows = [c for i in range(n) for c in [*inv[i], -_sum([inv[i][j] * m(j, n) for j in range(n)])]]
    return F.when(det.isNotNull(), F.array(*rows, *([F.lit(0.0)] * n), F.lit(1.0)))


def reverse_axes(a: Column, n: int) -> Column:
    """The same affine in the opposite order of axes (zyx and xyz)."""
    to = [*range(n - 1, -1, -1), n]
    return F.array(*(_at(a, n, to[i], to[j]) for i in range(n + 1) for j in range(n + 1)))


def without_axis(a: Column, n: int, axis: int) -> Column:
    """The affine's minor without one axis."""
    keep = [i for i in range(n + 1) if i != axis]
    return F.array(*(_at(a, n, i, j) for i in keep for j in keep))


def with_axes(a: Column, n: int, m: int) -> Column:
    """An affine of n dimensions as one of m, the identity on the m - n leading axes."""
    k = m - n
    cell = lambda i, j: _at(a, n, i - k, j - k) if i >= k and j >= k else F.lit(float(i == j))
    return F.array(*(cell(i, j) for i in range(m + 1) for j in range(m + 1)))


def aligned(left: DataFrame, right: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """(transform_key, view_id, t, affine) with affine = left @ right by view and frame.

    inner: frames that both have. full_outer: a frame that one side lacks counts as the identity there, which is how a
    transform is rebased on another.
    """
    a = left.select("view_id", "t", F.col("affine").alias("a"), F.col("transform_key"))
    b = right.select(F.col("view_id").alias("vb"), F.col("t").alias("tb"), F.col("affine").alias("b"))
    both = a.join(b, (F.col("view_id") == F.col("vb")) & (F.col("t") == F.col("tb")), how)
    first, second = F.coalesce("a", identity(n)), F.coalesce("b", identity(n))
    return both.select("transform_key", F.coalesce("view_id", "vb").alias("view_id"), F.coalesce("t", "tb").alias("t"), multiply(first, second, n).alias("affine"))
