"""Boxes, corners, cells, overlap volumes and blending weights as column expressions; polytopes in numpy."""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations, product
from operator import add, mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine

#: A view spans its pixel centres: origin .. origin + (shape - 1) * spacing.


def corners(shape: Column, spacing: Column, origin: Column, n: int) -> list[Column]:
    """The 2^n corner positions of a view, first corner at the origin."""
    at = lambda c, d: F.get(c, F.lit(d))
    return [F.array(*(at(origin, d) + (at(shape, d) - 1) * at(spacing, d) * far[d] for d in range(n))) for far in product((0, 1), repeat=n)]


def _coordinate(d: int, point: Column) -> Column:
    return F.get(point, F.lit(d))


def boxes(levels: DataFrame, transforms: DataFrame, n: int) -> DataFrame:
    """(view_id, shape, spacing, origin, affine, lo, hi): views with their axis-aligned world boxes."""
    placed = levels.join(transforms.select("view_id", "affine"), "view_id")
    world = [affine.apply(F.col("affine"), c, n) for c in corners(F.col("shape"), F.col("spacing"), F.col("origin"), n)]
    spread = placed.withColumn("_corners", F.array(*world))

    def side(f) -> Column:
        return F.array(*(f(F.transform("_corners", partial(_coordinate, d))) for d in range(n)))

    return spread.withColumns({"lo": side(F.array_min), "hi": side(F.array_max)}).drop("_corners")


def extended(props: DataFrame, by: float, n: int) -> DataFrame:
    """Views made larger by ``by`` on the low side and ceil(2 * by / spacing) pixels in all; a negative value shrinks."""
    shape = F.array(*((F.get("shape", F.lit(d)) + F.ceil(2 * by / F.get("spacing", F.lit(d)))).cast("int") for d in range(n)))
    return props.withColumns({"shape": shape, "origin": F.array(*(F.get("origin", F.lit(d)) - by for d in range(n)))})


def overlap_volume(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, n: int) -> Column:
    """Volume of the intersection of two boxes; -1 where they do not overlap or only touch."""
    sides = [F.least(F.get(hi_a, F.lit(d)), F.get(hi_b, F.lit(d))) - F.greatest(F.get(lo_a, F.lit(d)), F.get(lo_b, F.lit(d))) for d in range(n)]
    some = reduce(lambda a, b: a & b, (s > 0 for s in sides))
    return F.when(some, reduce(mul, sides)).otherwise(F.lit(-1.0))


def cell_join(left: DataFrame, right: DataFrame, n: int, cell: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of rows whose boxes meet (touching included): an equi-join on grid cells instead of a nested loop.

    Each box is listed under the cells that it covers; a pair is kept only in the first cell that both cover, so that
    no distinct is needed. ``cell`` should be about the size of the boxes. Columns of both sides must have different names
    but for lo and hi, which the right side has as r_lo and r_hi.
    """
    keys = [f"_c{d}" for d in range(n)]
    first = lambda c: F.floor(c / cell)

    def listed(df: DataFrame, a: str, b: str) -> DataFrame:
        for d, k in enumerate(keys):
            df = df.withColumn(k, F.explode(F.sequence(first(F.get(a, F.lit(d))), first(F.get(b, F.lit(d))))))
        return df

    right = right.withColumnsRenamed({lo: f"r_{lo}", hi: f"r_{hi}"})
    met = listed(left, lo, hi).join(listed(right, f"r_{lo}", f"r_{hi}"), keys)
    once = [F.col(k) == first(F.greatest(F.get(lo, F.lit(d)), F.get(f"r_{lo}", F.lit(d)))) for d, k in enumerate(keys)]
    touch = [(F.get(lo, F.lit(d)) <= F.get(f"r_{hi}", F.lit(d))) & (F.get(f"r_{lo}", F.lit(d)) <= F.get(hi, F.lit(d))) for d in range(n)]
    return met.where(reduce(lambda a, b: a & b, once + touch)).drop(*keys)


def support_distance(position: list[Column], shape: list[Column], spacing: list[Column], origin: list[Column], widths: list[float]) -> Column:
    """Distance to the border, in blending widths, of a position in a view that is one pixel larger on each side.

    Interpolated (multi)linearly on a support of 5 points a dimension, whose values are the distances to the nearest face.
    """
    n = len(position)
    step = [(shape[d] + 1) / 4.0 * spacing[d] for d in range(n)]
    u = [F.least(F.greatest((position[d] - origin[d] + spacing[d]) / step[d], F.lit(0.0)), F.lit(4.0)) for d in range(n)]
    i = [F.least(F.floor(u[d]), F.lit(3)) for d in range(n)]
    f = [u[d] - i[d] for d in range(n)]
    terms = []
    for far in product((0, 1), repeat=n):
        weight = reduce(mul, (f[d] if far[d] else 1 - f[d] for d in range(n)))
        near = [F.least(i[d] + far[d], 4 - (i[d] + far[d])) * step[d] / widths[d] for d in range(n)]
        terms.append(weight * (F.least(*near) if n > 1 else near[0]))
    return reduce(add, terms)


def blending_weight(distance: Column) -> Column:
    """Cosine ramp of a support distance: 0 at the border, 1 from one blending width on."""
    return F.when(distance < 1, (F.cos((1 - distance) * F.lit(float(np.pi))) + 1) / 2).otherwise(F.lit(1.0))


def halfspaces(lo: np.ndarray, hi: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Faces of an affinely placed box as outward unit normals and offsets: inside is n . p + c <= 0."""
    n = len(lo)
    faces = np.concatenate([np.concatenate([-np.eye(n), lo[:, None]], axis=1), np.concatenate([np.eye(n), -hi[:, None]], axis=1)])
    moved = faces @ np.linalg.inv(matrix)
    return moved / np.linalg.norm(moved[:, :n], axis=1, keepdims=True)


def polytope(faces: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Vertices of the intersection of halfspaces: the feasible meeting points of n faces."""
    n = faces.shape[1] - 1
    found = []
    for some in combinations(range(len(faces)), n):
        a = faces[list(some), :n]
        if abs(np.linalg.det(a)) > 1e-12:
            p = np.linalg.solve(a, -faces[list(some), n])
            if (faces[:, :n] @ p + faces[:, n] <= tolerance).all():
                found.append(p)
    if not found:
        return np.zeros((0, n))
    return np.unique(np.round(np.array(found), 9), axis=0)


def volume(faces: np.ndarray) -> float:
    """Volume of an intersection of halfspaces of 2 or 3 dimensions; -1 where it is empty or flat."""
    n = faces.shape[1] - 1
    faces = np.unique(np.round(faces, 9), axis=0)
    points = polytope(faces)
    if len(points) <= n:
        return -1.0
    middle = points.mean(axis=0)
    total = 0.0
    for face in faces:
        on = points[np.abs(points @ face[:n] + face[n]) < 1e-7]
        if len(on) < n:
            continue
        height = -(middle @ face[:n] + face[n])
        if n == 2:
            total += height * np.linalg.norm(on.max(axis=0) - on.min(axis=0)) / 2
        else:
            base = on - on.mean(axis=0)
            u = base[np.argmax(np.linalg.norm(base, axis=1))]
            u = u / np.linalg.norm(u)
            v = np.cross(face[:3] / np.linalg.norm(face[:3]), u)
            ring = np.argsort(np.arctan2(base @ v, base @ u))
            x, y = (base @ u)[ring], (base @ v)[ring]
            total += height * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 6
    return float(total) if total > 1e-12 else -1.0
