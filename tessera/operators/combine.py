"""Concatenation and stacking of image tables, and their transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(parts: list[DataFrame], dim: str, sizes: list[int] | None = None) -> DataFrame:
    """Parts one after the other along an existing dimension; with ``sizes`` a numeric coordinate goes on from part to part."""
    if sizes is not None:
        at = [sum(sizes[:k]) for k in range(len(parts))]
        parts = [p.withColumn(dim, F.col(dim) + o) for p, o in zip(parts, at, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack(parts: list[DataFrame], dim: str = "t", coords: list | None = None) -> DataFrame:
    """Parts along a new dimension; raises ValueError if they have it."""
    if any(dim in p.columns for p in parts):
        raise ValueError(f"{dim} is a dimension already")
    labels = coords if coords is not None else list(range(len(parts)))
    return reduce(lambda a, b: a.unionByName(b), (p.withColumn(dim, F.lit(c)) for p, c in zip(parts, labels, strict=True)))


def upsert(transforms: DataFrame, new: DataFrame, overwrite: bool = False, keys: tuple[str, ...] = ("transform_key", "view_id", "t", "c")) -> DataFrame:
    """``transforms`` with ``new`` rows: existing keys stay as they are, or are replaced with ``overwrite``. Nulls equal nulls."""
    old, fresh = (new, transforms) if overwrite else (transforms, new)
    right = old.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return old.unionByName(fresh.join(right, same, "left_anti"))


def chunk_aligned(sizes: list[int], chunk: int) -> bool:
    """Whether arrays can be concatenated by renaming chunks: all but the last end on a chunk border."""
    return all(s % chunk == 0 for s in sizes[:-1])
