"""Fusing pixels as they arrive: a streaming aggregation over world pixels of late or repeated tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse_stream(pixels: DataFrame, offsets: DataFrame, time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(wy, wx, vmax, vavg, n), in windows of ``time`` with a watermark if it is given; a stream-static join places the pixels."""
    placed = pixels.join(offsets, "view_id").select(*([time] if time else []), (F.col("y") + F.col("o_y")).alias("wy"), (F.col("x") + F.col("o_x")).alias("wx"), "v")
    keys = ["wy", "wx"]
    if time:
        placed = placed.withWatermark(time, late)
        keys = [F.window(time, window).alias("window"), *keys]
    return placed.groupBy(*keys).agg(F.max("v").alias("vmax"), F.avg("v").alias("vavg"), F.count("*").alias("n"))
