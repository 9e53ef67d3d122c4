"""Geometry of the output: its stack, its chunks, and which views each chunk needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_box(boxes: DataFrame, n: int, mode: str = "union") -> DataFrame:
    """(lower, upper) around all boxes (union) or inside all of them (intersection)."""
    low, high = (F.min, F.max) if mode == "union" else (F.max, F.min)
    if mode not in ("union", "intersection"):
        raise ValueError(f"unknown mode {mode}")
    side = lambda f, c: F.array(*(f(F.get(c, F.lit(d))) for d in range(n)))
    return boxes.agg(side(low, "lo").alias("lower"), side(high, "hi").alias("upper"))


def shape_of(extent: Column, spacing: Column) -> Column:
    """Pixels of an extent: floor(extent / spacing + 1e-9) + 1."""
    return (F.floor(extent / spacing + 1e-9) + 1).cast("int")


def stack(box: DataFrame, spacing: list[float]) -> DataFrame:
    """(origin, spacing, shape) of an output box."""
    n = len(spacing)
    shape = F.array(*(shape_of(F.get("upper", F.lit(d)) - F.get("lower", F.lit(d)), F.lit(spacing[d])) for d in range(n)))
    return box.select(F.col("lower").alias("origin"), F.array(*map(F.lit, spacing)).alias("spacing"), shape.alias("shape"))


def chunk_grid(stack_: DataFrame, chunk: list[int]) -> DataFrame:
    """(c0, c1, ..., lo, hi): a row for each output chunk with its box of pixel centres, made by sequences, one dimension at a time."""
    n = len(chunk)
    grid = stack_
    for d in range(n):
        grid = grid.withColumn(f"c{d}", F.explode(F.sequence(F.lit(0), F.floor((F.get("shape", F.lit(d)) - 1) / chunk[d]).cast("int"))))
    at = lambda c, d: F.get(c, F.lit(d))
    lo = F.array(*(at("origin", d) + F.col(f"c{d}") * chunk[d] * at("spacing", d) for d in range(n)))
    hi = F.array(*(at("origin", d) + (F.least((F.col(f"c{d}") + 1) * chunk[d], at("shape", d)) - 1) * at("spacing", d) for d in range(n)))
    return grid.select(*(f"c{d}" for d in range(n)), lo.alias("lo"), hi.alias("hi"))


def fusion_plan(boxes: DataFrame, stack_: DataFrame, chunk: list[int], halo: float = 0.0) -> DataFrame:
    """(view_id, c0, c1, ...): the chunks that each view touches, its box grown by ``halo``.

    Chunk indices follow from the box by floor division, so the plan is a hash join in all but name: no chunk is compared
    with every view. The one-row stack is collected, not joined.
    """
    n, s = len(chunk), stack_.first()
    plan = boxes
    for d in range(n):
        width = chunk[d] * s["spacing"][d]
        last = (s["shape"][d] - 1) // chunk[d]
        # A chunk ends at its last pixel centre; between that and the next chunk's first there is nothing to sample.
        first = F.floor((F.get("lo", F.lit(d)) - halo - s["origin"][d] + s["spacing"][d]) / width)
        reach = F.floor((F.get("hi", F.lit(d)) + halo - s["origin"][d]) / width)
        start = F.greatest(first, F.lit(0))
        stop = F.least(reach, F.lit(last))
        plan = plan.withColumn(f"_a{d}", start).withColumn(f"_b{d}", stop).where(F.col(f"_a{d}") <= F.col(f"_b{d}")).withColumn(f"c{d}", F.explode(F.sequence(F.col(f"_a{d}").cast("int"), F.col(f"_b{d}").cast("int"))))
        low = s["origin"][d] + F.col(f"c{d}") * width
        high = s["origin"][d] + (F.least((F.col(f"c{d}") + 1) * chunk[d], F.lit(s["shape"][d])) - 1) * s["spacing"][d]
        plan = plan.where((F.get("lo", F.lit(d)) - halo <= high) & (F.get("hi", F.lit(d)) + halo >= low))
    return plan.select("view_id", *(f"c{d}" for d in range(n)))


def combined(stacks: DataFrame, n: int) -> DataFrame:
    """One (origin, spacing, shape) around stacks: least origin and spacing, and the pixels to the furthest end."""
    at = lambda c, d: F.get(c, F.lit(d))
    ends = stacks.agg(*(F.min(at("origin", d)).alias(f"o{d}") for d in range(n)), *(F.min(at("spacing", d)).alias(f"s{d}") for d in range(n)), *(F.max(at("origin", d) + (at("shape", d) - 1) * at("spacing", d)).alias(f"e{d}") for d in range(n)))
    array = lambda p: F.array(*(F.col(f"{p}{d}") for d in range(n)))
    return ends.select(array("o").alias("origin"), array("s").alias("spacing"), F.array(*(shape_of(F.col(f"e{d}") - F.col(f"o{d}"), F.col(f"s{d}")) for d in range(n))).alias("shape"))
