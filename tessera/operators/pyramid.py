"""Resolution levels: block means, their geometry, and which level a request needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST = 100


def downsample(pixels: DataFrame, keys: list[str], dims: list[str], factor: dict[str, int], shape: dict[str, int], value: str = "v") -> DataFrame:
    """Means of whole blocks; the remainder of a dimension is trimmed. Combined before the shuffle."""
    trimmed = pixels.where(reduce(lambda a, b: a & b, (F.col(d) < shape[d] // factor[d] * factor[d] for d in dims)))
    cells = [F.floor(F.col(d) / factor[d]).cast("long").alias(d) for d in dims]
    return trimmed.groupBy(*keys, *cells).agg(F.avg(value).alias(value))


def resolution_levels(shape: dict[str, int], smallest: int = SMALLEST) -> list[dict]:
    """Levels of (level, shape, relative and absolute factor of each dimension): halved while half of it exceeds ``smallest``."""
    levels = [{"level": 0, "shape": dict(shape), "relative": dict.fromkeys(shape, 1), "absolute": dict.fromkeys(shape, 1)}]
    while True:
        last = levels[-1]
        by = {d: 2 if s // 2 > smallest else 1 for d, s in last["shape"].items()}
        if set(by.values()) == {1}:
            return levels
        levels.append({"level": last["level"] + 1, "shape": {d: s // by[d] for d, s in last["shape"].items()}, "relative": by, "absolute": {d: a * by[d] for d, a in last["absolute"].items()}})


def level_geometry(levels: DataFrame) -> DataFrame:
    """Spacing and origin of levels from level 0: columns factor, spacing0, origin0; origin_k = origin + (f - 1) * spacing / 2."""
    return levels.withColumns({"spacing": F.col("spacing0") * F.col("factor"), "origin": F.col("origin0") + (F.col("factor") - 1) * F.col("spacing0") / 2})


def coarsest_within(levels: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """(keys, level): the coarsest level before the first whose spacing exceeds ``target``; level 0 at least.

    levels: a row a level and dimension (keys, level, spacing).
    """
    fits = levels.groupBy(*keys, "level").agg(F.max("spacing").alias("spacing")).withColumn("miss", F.col("spacing") > target)
    return fits.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("miss"), F.col("level"))) - 1, F.max("level")).alias("level")).withColumn("level", F.greatest("level", F.lit(0)))


def level_for_binning(factors: list[dict[str, int]], binning: dict[str, int]) -> tuple[int, dict[str, int]]:
    """(level, what is left to bin): the coarsest level whose factors divide the binning."""
    good = [k for k, f in enumerate(factors) if all(binning[d] % f[d] == 0 for d in binning)]
    return good[-1], {d: binning[d] // factors[good[-1]][d] for d in binning}
