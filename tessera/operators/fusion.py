"""Fusion: pixels of all views grouped by their place in the world.

For translations by whole pixels a view's pixel lands on one world pixel, so fusing is an equi-join with the views'
offsets and one aggregation, combined before it is shuffled. Null is outside a view; uncovered world pixels have no row
(``dense`` gives them 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry


def placed(pixels: DataFrame, offsets: DataFrame, dims: list[str], prefix: str = "w") -> DataFrame:
    """``pixels`` with their world coordinates; offsets: (view_id, o_<dim>...) of whole pixels."""
    both = pixels.join(offsets, "view_id")
    return both.withColumns({f"{prefix}{d}": F.col(d) + F.col(f"o_{d}") for d in dims})


def fuse(world: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, vmax, vavg, n): maximum, average and number of the views at each world pixel."""
    return world.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("vmax"), F.avg(value).alias("vavg"), F.count("*").alias("n"))


def blending(world: DataFrame, dims: list[str], shape: list[int], widths: list[float], shrink: float = 0.0) -> DataFrame:
    """Adds ``w``, the blending weight of a pixel in its own view (unit spacing, origin 0).

    shrink moves the border inwards by that distance, so that weights reach 0 before it.
    """
    position = [F.col(d).cast("double") for d in dims]
    spacing = [F.lit(1.0)] * len(dims)
    origin = [F.lit(float(shrink))] * len(dims)
    size = [F.lit(float(s - 2 * shrink)) for s in shape]
    distance = geometry.support_distance(position, size, spacing, origin, widths)
    return world.withColumn("w", geometry.blending_weight(distance))


def normalized(weighted: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Adds ``wn``: weights over their sum at each world pixel; a sum of 0 divides by 1."""
    total = weighted.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    return weighted.join(total, keys).withColumn("wn", F.col(weight) / F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))).drop("_sum")


def weighted_average(weighted: DataFrame, keys: list[str], value: str = "v", weight: Column | None = None) -> DataFrame:
    """(keys, fused): sum(v * w) / sum(w), 0 where the weights are all 0. Numerator and denominator are one aggregation."""
    w = F.col("w") if weight is None else weight
    sums = weighted.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(F.col(value) * w).alias("_a"), F.sum(w).alias("_b"))
    return sums.select(*keys, (F.col("_a") / F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_b"))).alias("fused"))


def dense(fused: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row for every pixel of ``grid``, 0 where nothing was fused."""
    return grid.join(fused, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def cast_like(value: Column, dtype: str) -> Column:
    """A fused value as one of the first view's kind: truncated, clamped to its range, null as 0."""
    ranges = {"uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1)}
    v = F.coalesce(value, F.lit(0.0))
    if dtype not in ranges:
        return v.cast("double")
    lo, hi = ranges[dtype]
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))).cast("long")
