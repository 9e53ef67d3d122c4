"""Tiled images derived from the TPC-H-like test tables: views of 16 x 16 pixels on a grid with overlaps of 4.

Each function gives a table of the schema's kind for ``sf_dir``; ``SQL`` holds the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import affine

EDGE, STRIDE, ACROSS = 16, 12, 10


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view_id, oy, ox, ry, rx): stage and registered offsets."""
    k = F.col("s_suppkey").cast("long")
    oy, ox = F.floor(k / float(ACROSS)).cast("long") * STRIDE, (k % ACROSS) * STRIDE
    return _read(spark, sf_dir, "supplier").select(k.alias("view_id"), oy.alias("oy"), ox.alias("ox"), (oy + k * 7 % 3 - 1).alias("ry"), (ox + k * 5 % 3 - 1).alias("rx"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view_id, y, x, v), sparse."""
    rows = _read(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").cast("long").alias("view_id"), (F.col("l_partkey").cast("long") % EDGE).alias("y"), (F.col("l_orderkey").cast("long") % EDGE).alias("x")]
    return rows.groupBy(*keys).agg(F.max(F.col("l_quantity").cast("double")).alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, view_id, py, px)."""
    place = lambda i: F.round(F.element_at("embedding", i).cast("double") * 20 + 8, 3)
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("point_id"), F.col("label").cast("int").alias("view_id"), place(1).alias("py"), place(2).alias("px"))


def timelapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view_id, t, y, x, v)."""
    e = F.col("event_id").cast("long")
    keys = [(F.col("user_id").cast("long") % 4).alias("view_id"), (F.dayofmonth("ts") - 1).cast("int").alias("t"), (e % EDGE).alias("y"), (F.floor(e / 16.0).cast("long") % EDGE).alias("x")]
    return _read(spark, sf_dir, "events").groupBy(*keys).agg(F.max("value").alias("v"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view_id, shape, spacing, origin) of the views."""
    return views(spark, sf_dir).select("view_id", F.array(F.lit(EDGE), F.lit(EDGE)).alias("shape"), affine.literal((1, 1)).alias("spacing"), affine.literal((0, 0)).alias("origin"))


def transforms(spark: SparkSession, sf_dir: str, key: str = "stage") -> DataFrame:
    """(view_id, affine): stage or registered placement."""
    y, x = ("oy", "ox") if key == "stage" else ("ry", "rx")
    return views(spark, sf_dir).select("view_id", affine.translation([F.col(y), F.col(x)]).alias("affine"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, dy, dx, quality, lo_y, lo_x, hi_y, hi_x, overlap): overlapping pairs with made-up shifts."""
    from tessera.operators.overlap import overlaps

    found = overlaps(levels(spark, sf_dir), transforms(spark, sf_dir), 2, float(EDGE))
    s, d, at = F.col("src"), F.col("dst"), lambda c, i: F.get(c, F.lit(i)).cast("long")
    return found.select(
        "src", "dst", ((s * 7 + d * 3) % 5 - 2).alias("dy"), ((s * 11 + d * 5) % 5 - 2).alias("dx"), (((s * 13 + d * 17) % 100).cast("double") / 100).alias("quality"),
        at("bbox_lower", 0).alias("lo_y"), at("bbox_lower", 1).alias("lo_x"), at("bbox_upper", 0).alias("hi_y"), at("bbox_upper", 1).alias("hi_x"), F.col("overlap").cast("long").alias("overlap"),
    )


SQL = {
    "fx_views": """select cast(s_suppkey as bigint) as view_id, cast(floor(s_suppkey / 10.0) as bigint) * 12 as oy, cast((s_suppkey % 10) * 12 as bigint) as ox,
        cast(floor(s_suppkey / 10.0) as bigint) * 12 + (s_suppkey * 7) % 3 - 1 as ry, cast((s_suppkey % 10) * 12 + (s_suppkey * 5) % 3 - 1 as bigint) as rx from supplier""",
    "fx_pixels": "select cast(l_suppkey as bigint) as view_id, cast(l_partkey % 16 as bigint) as y, cast(l_orderkey % 16 as bigint) as x, max(cast(l_quantity as double)) as v from lineitem group by 1, 2, 3",
    "fx_points": "select cast(vec_id as bigint) as point_id, cast(label as int) as view_id, round(cast(embedding[1] as double) * 20 + 8, 3) as py, round(cast(embedding[2] as double) * 20 + 8, 3) as px from embeddings",
    "fx_timelapse": "select cast(user_id % 4 as bigint) as view_id, cast(day(ts) - 1 as int) as t, cast(event_id % 16 as bigint) as y, cast(floor(event_id / 16.0) as bigint) % 16 as x, max(value) as v from events group by 1, 2, 3, 4",
    "fx_edges": """select a.view_id as src, b.view_id as dst, (a.view_id * 7 + b.view_id * 3) % 5 - 2 as dy, (a.view_id * 11 + b.view_id * 5) % 5 - 2 as dx,
        cast((a.view_id * 13 + b.view_id * 17) % 100 as double) / 100 as quality, greatest(a.oy, b.oy) as lo_y, greatest(a.ox, b.ox) as lo_x, least(a.oy, b.oy) + 15 as hi_y, least(a.ox, b.ox) + 15 as hi_x,
        (least(a.oy, b.oy) + 15 - greatest(a.oy, b.oy)) * (least(a.ox, b.ox) + 15 - greatest(a.ox, b.ox)) as overlap
        from fx_views a join fx_views b on a.view_id < b.view_id where least(a.oy, b.oy) + 15 > greatest(a.oy, b.oy) and least(a.ox, b.ox) + 15 > greatest(a.ox, b.ox)""",
}


def with_fixtures(sql: str) -> str:
    """A query with the fixture tables that it names in front of it."""
    need = [n for n in SQL if n in sql]
    if "fx_edges" in need and "fx_views" not in need:
        need.append("fx_views")
    if not need:
        return sql.strip()
    order = [n for n in ("fx_views", "fx_pixels", "fx_points", "fx_timelapse", "fx_edges") if n in need]
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {head},\n{body[14:]}"
    return f"with {head},\n{body[4:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
