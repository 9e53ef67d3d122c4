"""Which views overlap: the self-join of views, for axis-aligned and rotated placements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry


def overlaps(levels: DataFrame, transforms: DataFrame, n: int, cell: float, tolerance: float = 0.0, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, overlap, bbox_lower, bbox_upper) of views whose boxes share a volume, src < dst.

    levels and transforms: one row a view (the first frame and channel decide). tolerance extends every view; pairs (src, dst)
    replaces the search by a list. Boxes that only touch do not overlap. For translations and scalings; see ``rotated``.
    """
    props = geometry.extended(levels, tolerance, n) if tolerance else levels
    box = geometry.boxes(props, transforms, n)
    a = box.select(F.col("view_id").alias("src"), "lo", "hi")
    b = box.select(F.col("view_id").alias("dst"), "lo", "hi")
    if pairs is None:
        met = geometry.cell_join(a, b, n, cell).where("src < dst")
    else:
        ordered = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        met = ordered.join(a, "src").join(b.withColumnsRenamed({"lo": "r_lo", "hi": "r_hi"}), "dst")
    both = met.withColumn("overlap", geometry.overlap_volume(F.col("lo"), F.col("hi"), F.col("r_lo"), F.col("r_hi"), n)).where("overlap > 0")
    lower = F.zip_with("lo", "r_lo", lambda x, y: F.greatest(x, y))
    upper = F.zip_with("hi", "r_hi", lambda x, y: F.least(x, y))
    return both.select("src", "dst", "overlap", lower.alias("bbox_lower"), upper.alias("bbox_upper"))


def rotated(levels: DataFrame, transforms: DataFrame, n: int, cell: float) -> DataFrame:
    """(src, dst, overlap) of views under any affine: boxes find candidates, polytopes decide, in Arrow batches."""
    box = geometry.boxes(levels, transforms, n)
    one = lambda name, p: box.select(F.col("view_id").alias(name), "lo", "hi", *(F.col(c).alias(f"{p}_{c}") for c in ("shape", "spacing", "origin", "affine")))
    met = geometry.cell_join(one("src", "a"), one("dst", "b"), n, cell).where("src < dst")

    def faces(r: pd.Series, p: str) -> np.ndarray:
        lo = np.array(r[f"{p}_origin"])
        hi = lo + (np.array(r[f"{p}_shape"]) - 1) * np.array(r[f"{p}_spacing"])
        return geometry.halfspaces(lo, hi, np.array(r[f"{p}_affine"]).reshape(n + 1, n + 1))

    def measure(batches):
        for batch in batches:
            found = [geometry.volume(np.concatenate([faces(r, "a"), faces(r, "b")])) for _, r in batch.iterrows()]
            yield pd.DataFrame({"src": batch["src"], "dst": batch["dst"], "overlap": np.array(found, dtype=float)})

    return met.drop("lo", "hi", "r_lo", "r_hi").mapInPandas(measure, "src long, dst long, overlap double").where("overlap > 0")


def mask_pairs(world: DataFrame, dims: list[str], value: str = "v") -> DataFrame:
    """(src, dst) of views whose masks touch: a world pixel belongs to the lowest view that is set there, and pixels of different
    views beside each other make a pair, once."""
    labels = world.where(F.col(value) > 0).groupBy(*dims).agg((F.min("view_id") + 1).alias("label"))
    return neighbour_labels(labels, dims).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def neighbour_labels(labels: DataFrame, dims: list[str], label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b): distinct directed pairs of different non-zero labels on neighbouring pixels of an image, 0-based.

    Neighbours are one step forward along each axis; in three dimensions also forward in-plane diagonals.
    """
    from itertools import product

    steps = [s for s in product((0, 1), repeat=len(dims)) if 0 < sum(s) < max(len(dims), 2)]
    here = labels.where(F.col(label) != 0).select(*by, *dims, F.col(label).alias("a"))
    there = F.explode(F.array(*(F.struct(*((F.col(d) - k).alias(d) for d, k in zip(dims, s, strict=True))) for s in steps))).alias("to")
    moved = labels.where(F.col(label) != 0).select(*by, F.col(label).alias("b"), there).select(*by, "b", "to.*")
    return here.join(moved, [*by, *dims]).where("a <> b").select(*by, (F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b")).distinct()
