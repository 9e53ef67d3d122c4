"""One-dimensional grouping of views by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of equal width that the range of values is cut into; each is ordered in a task of its own.
STRETCHES = 4096


def gaps(rows: DataFrame, value: str, tie: str, eps: float) -> DataFrame:
    """Adds ``cluster``: runs of values whose neighbours are at most ``eps`` apart, counted from 0 in order.

    Distinct values are ordered within stretches of the range; what a stretch passes on to the next (its last value and its
    number of steps) is one row, so only ``STRETCHES`` + 2 rows are ever ordered together. Rows without a value go.
    """
    values = rows.select(value).where(F.col(value).isNotNull()).distinct()
    first, last = values.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    stretch = F.lit(0)
    if first is not None and first < last:
        stretch = F.coalesce(F.width_bucket(F.col(value).cast("double"), F.lit(first), F.lit(last), F.lit(STRETCHES)), F.lit(0))
    within = Window.partitionBy("_stretch").orderBy(value)
    far = lambda a, b: F.coalesce((a - b > eps).cast("long"), F.lit(0))
    steps = values.withColumn("_stretch", stretch).withColumn("_new", far(F.col(value), F.lag(value).over(within)))
    ends = steps.groupBy("_stretch").agg(F.min(value).alias("_first"), F.max(value).alias("_last"), F.sum("_new").alias("_steps"))
    order = Window.orderBy("_stretch")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    bases = ends.withColumn("_new", far(F.col("_first"), F.lag("_last").over(order))).select("_stretch", (F.sum("_new").over(until) + F.sum("_steps").over(until) - F.col("_steps")).alias("_base"))
    numbered = steps.withColumn("cluster", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(bases), "_stretch").select(value, (F.col("cluster") + F.col("_base")).alias("cluster"))
    return rows.join(numbered, value).select(*rows.columns, "cluster")
