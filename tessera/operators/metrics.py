"""Registration quality: correlation of overlapping pixels, by pair and over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_pixels(edges: DataFrame, world: DataFrame, keys: list[str], value: str = "v", bounds: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(src, dst, keys, a, b): values of both views of an edge, src < dst, at shared world pixels.

    world: (view_id, keys, value). bounds names, for a key, the columns of ``edges`` with the overlap's first and last
    position. Each side meets the edges of its view first, within those bounds, so that pixels outside every overlap are
    not shuffled by position and pixels of views without a common edge never meet.
    """
    bounds = bounds or {}
    listed = edges.where("src < dst").select("src", "dst", *(c for pair in bounds.values() for c in pair)).distinct()

    def side(name: str, c: str) -> DataFrame:
        met = listed.join(world.select(F.col("view_id").alias(name), *keys, F.col(value).alias(c)), name)
        for key, (first, last) in bounds.items():
            met = met.where(F.col(key).between(F.col(first), F.col(last)))
        return met.select("src", "dst", *keys, c)

    return side("src", "a").join(side("dst", "b"), ["src", "dst", *keys])


def cross_correlation(pairs: DataFrame) -> DataFrame:
    """(src, dst, n, ncc): Pearson correlation of the pixels valid in both; null for fewer than two or for no variation."""
    stats = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    small = (F.col("n") < 2) | (F.col("sa") * F.col("sb") * F.col("n") < 1e-10) | F.isnan("r")
    return stats.select("src", "dst", "n", F.when(small, None).otherwise(F.col("r")).alias("ncc"))


def spearman(pairs: DataFrame) -> DataFrame:
    """(src, dst, n, rho): correlation of average ranks. The windows share one partitioning by edge."""
    own = Window.partitionBy("src", "dst")

    def ranked(c: str):
        ties = F.count("*").over(Window.partitionBy("src", "dst", c))
        return F.rank().over(own.orderBy(c)) + (ties - 1) / 2.0

    ranks = pairs.withColumns({"ra": ranked("a"), "rb": ranked("b")})
    out = ranks.groupBy("src", "dst").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    return out.withColumn("rho", F.when(F.isnan("rho"), None).otherwise(F.col("rho")))


def custom(pairs: DataFrame, functions: dict, keys: list[str]) -> DataFrame:
    """(src, dst, metric, value) of functions ``f(fixed, moving) -> float`` over the values of each pair in order of keys."""
    import pandas as pd

    def measure(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(keys)
        a, b = part["a"].to_numpy(dtype=float), part["b"].to_numpy(dtype=float)
        return pd.DataFrame([{"src": key[0], "dst": key[1], "metric": name, "value": float(f(a, b))} for name, f in functions.items()])

    return pairs.groupBy("src", "dst").applyInPandas(measure, "src long, dst long, metric string, value double")


def summary(metrics: DataFrame, value: str, volume: str, keys: list[str] | None = None) -> DataFrame:
    """Mean weighted by overlap volume, without nulls."""
    known = metrics.where(F.col(value).isNotNull())
    return known.groupBy(*(keys or [])).agg((F.sum(F.col(value) * F.col(volume)) / F.sum(volume)).alias("weighted_mean"), F.count("*").alias("n_pairs"))
