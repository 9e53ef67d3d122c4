"""The two calls that users make: register views, and fuse them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine
from tessera.operators import blocks, fusion, graph, overlap, register, resample, resolve


@dataclass(frozen=True)
class RegistrationOptions:
    """What to do between finding overlaps and placing views."""

    cell: float = 2048.0
    tolerance: float = 0.0
    pairs: DataFrame | None = None
    pruning: str | None = None
    pruning_options: dict = field(default_factory=dict)
    method: object = register.phase_correlation
    method_options: dict = field(default_factory=dict)
    least_quality: float | None = None
    resolver: str = "global_optimization"
    resolver_options: dict = field(default_factory=dict)
    reference: int | None = None


def register_views(levels: DataFrame, transforms: DataFrame, pixels: DataFrame, options: RegistrationOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """((view_id, t, affine), edges): overlaps, pruning, pairwise registration, quality filter, resolution.

    levels: (view_id, shape, spacing, origin) with spacing 1; transforms: (view_id, affine), whole-pixel translations; pixels:
    (view_id, t, y, x, v). The affine is relative to the placement it starts from.
    """
    options = options or RegistrationOptions()
    nodes = levels.select("view_id")
    edges = overlap.overlaps(levels, transforms, 2, options.cell, options.tolerance, options.pairs)
    centres = transforms.join(levels, "view_id").select("view_id", affine.apply(F.col("affine"), F.transform("shape", lambda s: (s - 1) / 2.0), 2).alias("centre"))
    kept = graph.prune(edges, nodes, options.pruning, centres, 2, **options.pruning_options).select("src", "dst")
    edges = edges.join(kept, ["src", "dst"])
    offsets = transforms.select("view_id", *(F.round(F.get("affine", F.lit(i))).cast("long").alias(f"o_{d}") for i, d in ((2, "y"), (5, "x"))))
    world = fusion.placed(pixels, offsets, ["y", "x"]).select("view_id", "t", F.col("wy").alias("y"), F.col("wx").alias("x"), "v")
    found = register.register_pairs(edges, world, ["y", "x"], options.method, **options.method_options).join(edges.select("src", "dst", "overlap"), ["src", "dst"])
    if options.least_quality is not None:
        found = graph.filter_edges(found, "quality", options.least_quality)
    found = found.persist()
    return resolve.resolve(found, nodes, 2, options.resolver, options.reference, **options.resolver_options), found


def fuse_views(pixels: DataFrame, transforms: DataFrame, shape: tuple[int, int], method: str = "weighted_average", widths: tuple[float, float] = (10.0, 10.0), dtype: str | None = None, **options) -> DataFrame:
    """(y, x, fused) of the views' pixels (view_id, y, x, v) placed by affines (view_id, affine).

    Whole-pixel translations are joined as they are, others are interpolated first; views that are turned, scaled or
    sheared are resampled, a view a task. method: max, simple_average,
    weighted_average, content, dct or deconvolution.
    """
    offsets = transforms.select("view_id", *(F.get("affine", F.lit(i)).alias(f"o_{d}") for i, d in ((2, "y"), (5, "x"))))
    part = offsets.where((F.abs(F.col("o_y") - F.round("o_y")) > 1e-6) | (F.abs(F.col("o_x") - F.round("o_x")) > 1e-6))
    weighted = fusion.blending(pixels, ["y", "x"], list(shape), list(widths))
    turned = transforms.where(" or ".join(f"abs(affine[{i}] - {v}) > 1e-9" for i, v in ((0, 1), (1, 0), (3, 0), (4, 1))))
    if not turned.isEmpty():
        world = resample.resample_affine(weighted, transforms, ["y", "x"], ["v", "w"])
    elif part.isEmpty():
        whole = offsets.select("view_id", F.round("o_y").cast("long").alias("o_y"), F.round("o_x").cast("long").alias("o_x"))
        world = fusion.placed(weighted, whole, ["y", "x"]).select("view_id", "wy", "wx", "v", "w")
    else:
        values = resample.shift_linear(weighted, offsets, ["view_id"], ["y", "x"])
        weights = resample.shift_linear(weighted, offsets, ["view_id"], ["y", "x"], "w")
        world = values.join(weights, ["view_id", "wy", "wx"]).select("view_id", "wy", "wx", "v", "w")
    if method in ("max", "simple_average"):
        fused = fusion.fuse(world, ["wy", "wx"]).select(F.col("wy").alias("y"), F.col("wx").alias("x"), F.col("vmax" if method == "max" else "vavg").alias("fused"))
    elif method == "weighted_average":
        fused = fusion.weighted_average(world, ["wy", "wx"]).withColumnsRenamed({"wy": "y", "wx": "x"})
    else:
        fused = blocks.fuse_blocks(world.withColumnsRenamed({"wy": "y", "wx": "x"}), ["y", "x"], method, **options)
    return fused.withColumn("fused", fusion.cast_like(F.col("fused"), dtype)) if dtype else fused
