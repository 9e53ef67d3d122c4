"""Selections and projections by coordinates; label ranges include both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine


def select_coords(table: DataFrame, ranges: dict[str, tuple | list]) -> DataFrame:
    """Rows whose coordinates are in ranges: a (lo, hi) tuple includes both ends, a list names values. Pushed to the scan."""
    tests = [F.col(d).between(*r) if isinstance(r, tuple) else F.col(d).isin(r) for d, r in ranges.items()]
    return table.where(reduce(lambda a, b: a & b, tests)) if tests else table


def select_points(points: DataFrame, ranges: dict[str, tuple | list], position: dict[str, str]) -> DataFrame:
    """Points inside all ranges, whose bounds are included; a list stands for its least and greatest value. Points without a
    finite position go."""
    bounds = {d: r if isinstance(r, tuple) else (min(r), max(r)) for d, r in ranges.items()}
    finite = [F.col(c).isNotNull() & ~F.isnan(c) for c in position.values()]
    inside = [F.col(position[d]).between(*b) for d, b in bounds.items()]
    return points.where(reduce(lambda a, b: a & b, finite + inside))


def max_project(pixels: DataFrame, dim: str, keys: list[str], value: str = "v") -> DataFrame:
    """The maximum over one dimension."""
    return pixels.groupBy(*[k for k in keys if k != dim]).agg(F.max(value).alias(value))


def project_transforms(transforms: DataFrame, n: int, axis: int) -> DataFrame:
    """Affines without the rows and columns of a dropped dimension."""
    return transforms.withColumn("affine", affine.without_axis(F.col("affine"), n, axis))


def inside(position: list[Column], faces: Column) -> Column:
    """Whether a point is inside all halfspaces n . p + c <= 0; faces: ARRAY<ARRAY<DOUBLE>>."""
    n = len(position)
    return F.forall(faces, lambda f: reduce(lambda a, b: a + b, (F.get(f, F.lit(d)) * position[d] for d in range(n))) + F.get(f, F.lit(n)) <= 0)


def crop_to(pixels: DataFrame, boxes: DataFrame, dims: list[str], on: str = "view_id") -> DataFrame:
    """Pixels strictly inside the box (lo, hi) of their view."""
    both = pixels.join(boxes.select(on, "lo", "hi"), on)
    tests = [(F.col(d) > F.get("lo", F.lit(i))) & (F.col(d) < F.get("hi", F.lit(i))) for i, d in enumerate(dims)]
    return both.where(reduce(lambda a, b: a & b, tests)).select(*pixels.columns)
