"""Registered queries of the tile engine over the test tables, and the same results in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import affine, geometry
from tessera.operators import blocks, combine, fusion, graph, markers, metrics, overlap, pyramid, register, resample, resolve, selection
from tessera.plans import geometry as plan
from tessera.sources import fixtures as fx
from tessera.sources import viewer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WIDTHS = [10.0, 10.0]
EDGE = fx.EDGE


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its name, with its SQL if it can be said in SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = fx.with_fixtures(sql)
        return f

    return add


def offsets(spark: SparkSession, sf_dir: str, y: str = "oy", x: str = "ox") -> DataFrame:
    return fx.views(spark, sf_dir).select("view_id", F.col(y).alias("o_y"), F.col(x).alias("o_x"))


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.placed(fx.pixels(spark, sf_dir), offsets(spark, sf_dir), ["y", "x"])


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.blending(world(spark, sf_dir), ["y", "x"], [EDGE, EDGE], WIDTHS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.boxes(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2)


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transform_key, view_id, t, affine) of the stage for frame 0."""
    return fx.transforms(spark, sf_dir).select(F.lit("stage").alias("transform_key"), "view_id", F.lit(0).alias("t"), "affine")


# Fixtures.
for _name in ("views", "pixels", "points", "timelapse", "edges"):
    query(f"select * from fx_{_name}", f"fx_{_name}")(getattr(fx, _name))

# Fusion.
_WORLD = "select w.oy + p.y as wy, w.ox + p.x as wx, p.* from fx_pixels p join fx_views w on p.view_id = w.view_id"
_DISTANCE = """(1 - fy) * (1 - fx) * least(least(iy, 4 - iy) * 0.425, least(ix, 4 - ix) * 0.425) + (1 - fy) * fx * least(least(iy, 4 - iy) * 0.425, least(ix + 1, 3 - ix) * 0.425)
    + fy * (1 - fx) * least(least(iy + 1, 3 - iy) * 0.425, least(ix, 4 - ix) * 0.425) + fy * fx * least(least(iy + 1, 3 - iy) * 0.425, least(ix + 1, 3 - ix) * 0.425)"""
_WEIGHTED = f"""u as (select *, (y + 1) / 4.25 as uy, (x + 1) / 4.25 as ux from ({_WORLD}) q), i as (select *, least(floor(uy), 3) as iy, least(floor(ux), 3) as ix from u),
    f as (select *, uy - iy as fy, ux - ix as fx from i), e as (select *, {_DISTANCE} as d from f), g as (select *, case when d < 1 then (cos((1 - d) * pi()) + 1) / 2 else 1 end as w from e)"""


@query(f"select wy, wx, max(v) as vmax from ({_WORLD}) q group by wy, wx")
def fuse_max(spark, sf_dir):
    return fusion.fuse(world(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", "vmax")


@query(f"select wy, wx, round(avg(v), 6) as vavg, count(*) as n from ({_WORLD}) q group by wy, wx")
def fuse_simple_average(spark, sf_dir):
    return fusion.fuse(world(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", F.round("vavg", 6).alias("vavg"), "n")


@query(f"with {_WEIGHTED} select view_id, y, x, round(w, 6) as w from g")
def blending_weights(spark, sf_dir):
    return weighted(spark, sf_dir).select("view_id", "y", "x", F.round("w", 6).alias("w"))


@query(f"with {_WEIGHTED} select view_id, wy, wx, round(w / (case when sum(w) over (partition by wy, wx) = 0 then 1 else sum(w) over (partition by wy, wx) end), 6) as wn from g")
def normalize_weights(spark, sf_dir):
    return fusion.normalized(weighted(spark, sf_dir), ["wy", "wx"]).select("view_id", "wy", "wx", F.round("wn", 6).alias("wn"))


@query(f"with {_WEIGHTED} select wy, wx, round(sum(v * w) / (case when sum(w) = 0 then 1 else sum(w) end), 6) as fused from g group by wy, wx")
def fuse_weighted_average(spark, sf_dir):
    return fusion.weighted_average(weighted(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", F.round("fused", 6).alias("fused"))


@query(f"with {_WEIGHTED} select wy, wx, round(sum(v * w * (1 + view_id % 3)) / (case when sum(w * (1 + view_id % 3)) = 0 then 1 else sum(w * (1 + view_id % 3)) end), 6) as fused from g group by wy, wx")
def fuse_extra_weights(spark, sf_dir):
    extra = F.col("w") * (1 + F.col("view_id") % 3)
    return fusion.weighted_average(weighted(spark, sf_dir), ["wy", "wx"], weight=extra).select("wy", "wx", F.round("fused", 6).alias("fused"))


@query(
    f"""with b as (select min(oy) as y0, min(ox) as x0, max(oy) + 15 as y1, max(ox) + 15 as x1 from fx_views), ys as (select unnest(range(y0, y1 + 1)) as wy from b), xs as (select unnest(range(x0, x1 + 1)) as wx from b),
    m as (select wy, wx, max(v) as v from ({_WORLD}) q group by wy, wx) select cast(ys.wy as bigint) as wy, cast(xs.wx as bigint) as wx, cast(least(coalesce(v, 0), 255) as bigint) as v from ys cross join xs left join m on m.wy = ys.wy and m.wx = xs.wx"""
)
def fuse_dense_uint8(spark, sf_dir):
    box = plan.output_box(boxes(spark, sf_dir), 2).first()
    spans = [F.sequence(F.lit(int(box["lower"][d])).cast("long"), F.lit(int(box["upper"][d])).cast("long")) for d in (0, 1)]
    grid = spark.range(1).select(F.explode(spans[0]).alias("wy")).select("wy", F.explode(spans[1]).alias("wx"))
    fused = fusion.fuse(world(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", F.col("vmax").alias("v"))
    return fusion.dense(fused, grid, ["wy", "wx"], "v").withColumn("v", fusion.cast_like(F.col("v"), "uint8"))


# Overlaps.
_EDGES = "select src, dst, cast(overlap as double) as overlap from fx_edges"


@query(_EDGES)
def view_overlap(spark, sf_dir):
    return overlap.overlaps(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 16.0).select("src", "dst", "overlap")


@query(_EDGES)
def view_overlap_cell_join(spark, sf_dir):
    return overlap.overlaps(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 5.0).select("src", "dst", "overlap")


@query(
    """with e as (select view_id, oy - 2 as y0, ox - 2 as x0, oy - 2 + 19 as y1, ox - 2 + 19 as x1 from fx_views) select a.view_id as src, b.view_id as dst,
    cast((least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) as double) as overlap from e a join e b on a.view_id < b.view_id
    where least(a.y1, b.y1) > greatest(a.y0, b.y0) and least(a.x1, b.x1) > greatest(a.x0, b.x0)"""
)
def view_overlap_tolerance(spark, sf_dir):
    return overlap.overlaps(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 20.0, tolerance=2.0).select("src", "dst", "overlap")


@query("select src, dst, cast(overlap as double) as overlap from fx_edges where (src + dst) % 3 = 0")
def view_overlap_pairs(spark, sf_dir):
    pairs = fx.edges(spark, sf_dir).where("(src + dst) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return overlap.overlaps(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 16.0, pairs=pairs).select("src", "dst", "overlap")


@query(_EDGES.replace("cast(overlap as double)", "round(cast(overlap as double), 6)"))
def view_overlap_polytopes(spark, sf_dir):
    return overlap.rotated(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 16.0).select("src", "dst", F.round("overlap", 6).alias("overlap"))


# Output geometry.
@query("select cast(min(oy) as double) as y0, cast(min(ox) as double) as x0, cast(max(oy) + 15 as double) as y1, cast(max(ox) + 15 as double) as x1, cast(floor((max(oy) + 15 - min(oy)) / 0.5 + 1e-9) + 1 as int) as ny, cast(floor((max(ox) + 15 - min(ox)) / 0.5 + 1e-9) + 1 as int) as nx from fx_views")
def stack_union(spark, sf_dir):
    box = plan.output_box(boxes(spark, sf_dir), 2)
    size = plan.stack(box, [0.5, 0.5]).first()
    return box.select(F.get("lower", F.lit(0)).alias("y0"), F.get("lower", F.lit(1)).alias("x0"), F.get("upper", F.lit(0)).alias("y1"), F.get("upper", F.lit(1)).alias("x1"), F.lit(size["shape"][0]).alias("ny"), F.lit(size["shape"][1]).alias("nx"))


@query("select cast(max(oy) as double) as y0, cast(max(ox) as double) as x0, cast(min(oy) + 15 as double) as y1, cast(min(ox) + 15 as double) as x1 from fx_views")
def stack_intersection(spark, sf_dir):
    box = plan.output_box(boxes(spark, sf_dir), 2, "intersection")
    return box.select(F.get("lower", F.lit(0)).alias("y0"), F.get("lower", F.lit(1)).alias("x0"), F.get("upper", F.lit(0)).alias("y1"), F.get("upper", F.lit(1)).alias("x1"))


_GRID = """s as (select min(oy) as y0, min(ox) as x0, max(oy) + 16 - min(oy) as ny, max(ox) + 16 - min(ox) as nx from fx_views),
    cy as (select unnest(range(0, cast((ny - 1) // 32 as bigint) + 1)) as c0, * from s), c as (select unnest(range(0, cast((nx - 1) // 32 as bigint) + 1)) as c1, * from cy),
    b as (select cast(c0 as int) as c0, cast(c1 as int) as c1, cast(y0 + c0 * 32 as double) as lo_y, cast(x0 + c1 * 32 as double) as lo_x, cast(y0 + least((c0 + 1) * 32, ny) - 1 as double) as hi_y, cast(x0 + least((c1 + 1) * 32, nx) - 1 as double) as hi_x from c)"""


@query(f"with {_GRID} select * from b")
def chunk_grid(spark, sf_dir):
    grid = plan.chunk_grid(plan.stack(plan.output_box(boxes(spark, sf_dir), 2), [1.0, 1.0]), [32, 32])
    return grid.select("c0", "c1", *(F.get(c, F.lit(d)).alias(f"{c}_{a}") for c in ("lo", "hi") for d, a in enumerate("yx")))


@query(f"with {_GRID} select view_id, c0, c1 from fx_views v join b on v.oy <= b.hi_y and v.oy + 15 >= b.lo_y and v.ox <= b.hi_x and v.ox + 15 >= b.lo_x")
def fusion_plan(spark, sf_dir):
    box = boxes(spark, sf_dir)
    return plan.fusion_plan(box, plan.stack(plan.output_box(box, 2), [1.0, 1.0]), [32, 32])


# Selections.
@query("select * from fx_timelapse where t between 3 and 7 and y between 2 and 9 and x in (1, 3, 5)")
def sel_coords(spark, sf_dir):
    return selection.select_coords(fx.timelapse(spark, sf_dir), {"t": (3, 7), "y": (2, 9), "x": [1, 3, 5]})


@query("select p.view_id, p.y, p.x, p.v from fx_pixels p join fx_views w on p.view_id = w.view_id where p.y > w.ry - w.oy + 2 and p.y < w.ry - w.oy + 12 and p.x > w.rx - w.ox + 2 and p.x < w.rx - w.ox + 12")
def crop_reference(spark, sf_dir):
    v = fx.views(spark, sf_dir)
    box = lambda k: F.array((F.col("ry") - F.col("oy") + k).cast("double"), (F.col("rx") - F.col("ox") + k).cast("double"))
    return selection.crop_to(fx.pixels(spark, sf_dir), v.select("view_id", box(2).alias("lo"), box(12).alias("hi")), ["y", "x"])


@query("select view_id, y, x, max(v) as v from fx_timelapse group by view_id, y, x")
def max_project(spark, sf_dir):
    return selection.max_project(fx.timelapse(spark, sf_dir), "t", ["view_id", "t", "y", "x"])


@query("select * from fx_points where py between 5 and 11 and px between 4.5 and 12.25")
def points_sel(spark, sf_dir):
    return selection.select_points(fx.points(spark, sf_dir), {"y": (5.0, 11.0), "x": [4.5, 9.0, 12.25]}, {"y": "py", "x": "px"})


@query("select point_id, p.view_id, py >= 0 and py <= 15 and px >= 0 and px <= 15 and py + px <= 20 as inside from fx_points p")
def points_inside(spark, sf_dir):
    faces = F.array(*(affine.literal(f) for f in ((-1, 0, 0), (1, 0, -15), (0, -1, 0), (0, 1, -15), (1, 1, -20))))
    return fx.points(spark, sf_dir).select("point_id", "view_id", selection.inside([F.col("py"), F.col("px")], faces).alias("inside"))


@query("select * from fx_pixels where (y - 7.5) * 0.8 + (x - 7.5) * 0.6 <= 4 and (y - 7.5) * 0.6 - (x - 7.5) * 0.8 <= 3")
def mask_halfspace(spark, sf_dir):
    faces = F.array(affine.literal((0.8, 0.6, -7.5 * 1.4 - 4)), affine.literal((0.6, -0.8, 7.5 * 0.2 - 3)))
    return fx.pixels(spark, sf_dir).where(selection.inside([F.col("y").cast("double"), F.col("x").cast("double")], faces))


# Pyramid.
@query("select view_id, cast(floor(y / 2) as bigint) as y, cast(floor(x / 2) as bigint) as x, round(avg(v), 6) as v from fx_pixels group by 1, 2, 3")
def downsample_2x(spark, sf_dir):
    out = pyramid.downsample(fx.pixels(spark, sf_dir), ["view_id"], ["y", "x"], {"y": 2, "x": 2}, {"y": EDGE, "x": EDGE})
    return out.withColumn("v", F.round("v", 6))


@query("select view_id, cast(floor(y / 3) as bigint) as y, cast(floor(x / 5) as bigint) as x, round(avg(v), 6) as v from fx_pixels where y < 15 and x < 15 group by 1, 2, 3")
def downsample_trimmed(spark, sf_dir):
    out = pyramid.downsample(fx.pixels(spark, sf_dir), ["view_id"], ["y", "x"], {"y": 3, "x": 5}, {"y": EDGE, "x": EDGE})
    return out.withColumn("v", F.round("v", 6))


@query(
    """with recursive l as (select 0 as level, 1000 as ny, 700 as nx, 1 as fy, 1 as fx union all select level + 1, case when ny // 2 > 100 then ny // 2 else ny end, case when nx // 2 > 100 then nx // 2 else nx end,
    case when ny // 2 > 100 then fy * 2 else fy end, case when nx // 2 > 100 then fx * 2 else fx end from l where ny // 2 > 100 or nx // 2 > 100) select cast(level as int) as level, cast(ny as int) as ny, cast(nx as int) as nx, cast(fy as int) as fy, cast(fx as int) as fx from l"""
)
def resolution_levels(spark, sf_dir):
    rows = [(r["level"], r["shape"]["y"], r["shape"]["x"], r["absolute"]["y"], r["absolute"]["x"]) for r in pyramid.resolution_levels({"y": 1000, "x": 700})]
    return spark.createDataFrame(rows, "level int, ny int, nx int, fy int, fx int")


def _view_levels(spark, sf_dir) -> DataFrame:
    own = fx.views(spark, sf_dir).select("view_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"), (0.25 * (1 + F.col("view_id") % 3)).alias("spacing0"), F.col("oy").cast("double").alias("origin0"))
    return own.withColumn("factor", F.pow(F.lit(2.0), F.col("level")).cast("int"))


_LEVELS = "l as (select view_id, cast(k as int) as level, 0.25 * (1 + view_id % 3) as spacing0, cast(oy as double) as origin0, cast(pow(2, k) as int) as factor from fx_views, (select unnest(range(0, 5)) as k) r)"


@query(f"with {_LEVELS} select view_id, level, cast(spacing0 * factor as double) as spacing, cast(origin0 + (factor - 1) * spacing0 / 2 as double) as origin from l")
def multiscale_origins(spark, sf_dir):
    return pyramid.level_geometry(_view_levels(spark, sf_dir)).select("view_id", "level", "spacing", "origin")


@query(f"with {_LEVELS} select view_id, cast(greatest(coalesce(min(case when spacing0 * factor > 2 then level end) - 1, max(level)), 0) as int) as level from l group by view_id")
def res_level_from_spacing(spark, sf_dir):
    return pyramid.coarsest_within(pyramid.level_geometry(_view_levels(spark, sf_dir)), 2.0, ["view_id"]).withColumn("level", F.col("level").cast("int"))


# Affine algebra.
_TURN = "0.1 * (view_id % 7)"


def _turned(spark, sf_dir) -> DataFrame:
    angle = 0.1 * (F.col("view_id") % 7)
    v = fx.views(spark, sf_dir)
    return v.select("view_id", affine.multiply(affine.rotation_2d(angle), affine.translation([F.col("oy"), F.col("ox")]), 2).alias("affine"))


_AFFINE = f"a as (select view_id, cos({_TURN}) as a00, -sin({_TURN}) as a01, cos({_TURN}) * oy - sin({_TURN}) * ox as a02, sin({_TURN}) as a10, cos({_TURN}) as a11, sin({_TURN}) * oy + cos({_TURN}) * ox as a12 from fx_views)"


def _parts(c: str) -> list:
    return [(F.round(F.get(c, F.lit(3 * i + j)), 6) + 0.0).alias(f"a{i}{j}") for i in range(2) for j in range(3)]



@query(f"with {_AFFINE} select point_id, p.view_id, round(a00 * py + a01 * px + a02, 6) as wy, round(a10 * py + a11 * px + a12, 6) as wx from fx_points p join a on p.view_id = a.view_id")
def transform_points(spark, sf_dir):
    both = fx.points(spark, sf_dir).join(_turned(spark, sf_dir), "view_id")
    out = affine.apply(F.col("affine"), F.array("py", "px"), 2)
    return both.select("point_id", "view_id", F.round(F.get(out, F.lit(0)), 6).alias("wy"), F.round(F.get(out, F.lit(1)), 6).alias("wx"))


@query(f"with {_AFFINE} select a.view_id, round(a00, 6) + 0.0 as a00, round(a01, 6) + 0.0 as a01, round(a00 * ry + a01 * rx + a02, 6) + 0.0 as a02, round(a10, 6) + 0.0 as a10, round(a11, 6) + 0.0 as a11, round(a10 * ry + a11 * rx + a12, 6) + 0.0 as a12 from a join fx_views v on a.view_id = v.view_id")
def matmul_affine(spark, sf_dir):
    left = _turned(spark, sf_dir).select(F.lit("k").alias("transform_key"), "view_id", F.lit(0).alias("t"), "affine")
    right = fx.transforms(spark, sf_dir, "registered").select("view_id", F.lit(0).alias("t"), "affine")
    return affine.aligned(left, right, 2).select("view_id", *_parts("affine"))


@query(f"with {_AFFINE}, i as (select view_id, a11 / (a00 * a11 - a01 * a10) as b00, -a01 / (a00 * a11 - a01 * a10) as b01, -a10 / (a00 * a11 - a01 * a10) as b10, a00 / (a00 * a11 - a01 * a10) as b11, a02, a12 from a) select view_id, round(b00, 6) + 0.0 as a00, round(b01, 6) + 0.0 as a01, round(-(b00 * a02 + b01 * a12), 6) + 0.0 as a02, round(b10, 6) + 0.0 as a10, round(b11, 6) + 0.0 as a11, round(-(b10 * a02 + b11 * a12), 6) + 0.0 as a12 from i")
def invert_affine(spark, sf_dir):
    return _turned(spark, sf_dir).withColumn("affine", affine.invert(F.col("affine"), 2)).select("view_id", *_parts("affine"))


@query(
    """with x as (select view_id, cast(view_id % 3 as int) as t, ry - oy as dy, rx - ox as dx from fx_views), b as (select view_id, cast(0 as int) as t, oy, ox from fx_views)
    select coalesce(x.view_id, b.view_id) as view_id, coalesce(x.t, b.t) as t, cast(coalesce(dy, 0) + coalesce(oy, 0) as double) as ty, cast(coalesce(dx, 0) + coalesce(ox, 0) as double) as tx from x full outer join b on x.view_id = b.view_id and x.t = b.t"""
)
def rebase_affine(spark, sf_dir):
    v = fx.views(spark, sf_dir)
    new = v.select(F.lit("new").alias("transform_key"), "view_id", (F.col("view_id") % 3).cast("int").alias("t"), affine.translation([F.col("ry") - F.col("oy"), F.col("rx") - F.col("ox")]).alias("affine"))
    out = affine.aligned(new, stage(spark, sf_dir), 2, "full_outer")
    return out.select("view_id", "t", F.get("affine", F.lit(2)).alias("ty"), F.get("affine", F.lit(5)).alias("tx"))


# Metrics.
_PAIRS = f"w as ({_WORLD}), p as (select e.src, e.dst, a.v as a, b.v as b from fx_edges e join w a on a.view_id = e.src join w b on b.view_id = e.dst and a.wy = b.wy and a.wx = b.wx)"


def _pair_pixels(spark, sf_dir) -> DataFrame:
    return metrics.pair_pixels(fx.edges(spark, sf_dir), world(spark, sf_dir).select("view_id", "wy", "wx", "v"), ["wy", "wx"], bounds={"wy": ("lo_y", "hi_y"), "wx": ("lo_x", "hi_x")})


_NCC = "n as (select src, dst, count(*) as n, corr(a, b) as r, stddev_pop(a) * stddev_pop(b) * count(*) as den from p group by src, dst), m as (select src, dst, n, case when n < 2 or den < 1e-10 or isnan(r) then null else r end as ncc from n)"


@query(f"with {_PAIRS}, {_NCC} select src, dst, n, round(ncc, 6) as ncc from m")
def ncc_pairs(spark, sf_dir):
    return metrics.cross_correlation(_pair_pixels(spark, sf_dir)).withColumn("ncc", F.round("ncc", 6))


@query(f"with {_PAIRS}, {_NCC} select round(sum(ncc * overlap) / sum(overlap), 6) as weighted_mean, count(*) as n_pairs from m join fx_edges using (src, dst) where ncc is not null")
def ncc_summary_weighted(spark, sf_dir):
    ncc = metrics.cross_correlation(_pair_pixels(spark, sf_dir)).join(fx.edges(spark, sf_dir).select("src", "dst", "overlap"), ["src", "dst"])
    return metrics.summary(ncc, "ncc", "overlap").withColumn("weighted_mean", F.round("weighted_mean", 6))


@query(
    f"""with {_PAIRS}, r as (select src, dst, rank() over (partition by src, dst order by a) + (count(*) over (partition by src, dst, a) - 1) / 2.0 as ra, rank() over (partition by src, dst order by b) + (count(*) over (partition by src, dst, b) - 1) / 2.0 as rb from p),
    c as (select src, dst, count(*) as n, corr(ra, rb) as rho from r group by src, dst) select src, dst, n, round(case when isnan(rho) then null else rho end, 6) as rho from c"""
)
def spearman_quality(spark, sf_dir):
    return metrics.spearman(_pair_pixels(spark, sf_dir)).withColumn("rho", F.round("rho", 6))


# Graph.
@query(
    """with r as (select min(overlap) as lo, max(overlap) as hi from fx_edges), h as (select least(floor((overlap - lo) / ((hi - lo) / 256.0)), 255) as c, count(*) as n, any_value(lo) as lo, any_value(hi) as hi from fx_edges, r group by 1),
    k as (select c, n, lo + (c + 0.5) * (hi - lo) / 256.0 as m from h), s as (select m, c, sum(n) over (order by c) as nb, sum(n * m) over (order by c) as sb, sum(n) over () as nt, sum(n * m) over () as st from k),
    t as (select m from s where nt > nb order by nb * (nt - nb) * pow(sb / nb - (st - sb) / (nt - nb), 2) desc, c limit 1) select src, dst, overlap from fx_edges where overlap >= coalesce((select m from t), overlap)"""
)
def prune_otsu(spark, sf_dir):
    return graph.filter_edges(fx.edges(spark, sf_dir)).select("src", "dst", "overlap")


@query("select e.src, e.dst, e.overlap from fx_edges e join fx_views a on a.view_id = e.src join fx_views b on b.view_id = e.dst where acos(least(greatest(abs(a.oy - b.oy), abs(a.ox - b.ox)) / sqrt(pow(a.oy - b.oy, 2) + pow(a.ox - b.ox, 2)), 1)) < 0.05")
def prune_axis_aligned(spark, sf_dir):
    centres = fx.views(spark, sf_dir).select("view_id", F.array(F.col("oy") + 7.5, F.col("ox") + 7.5).alias("centre"))
    return graph.axis_aligned(fx.edges(spark, sf_dir), centres, 2).select("src", "dst", "overlap")


@query("select src, dst, quality from fx_edges where quality >= 0.4")
def filter_edges_quality(spark, sf_dir):
    return graph.filter_edges(fx.edges(spark, sf_dir), "quality", 0.4).select("src", "dst", "quality")


@query("select view_id, cast(sum(overlap) as bigint) as total from (select src as view_id, overlap from fx_edges union all select dst, overlap from fx_edges) group by view_id order by total desc, view_id limit 1")
def reference_view(spark, sf_dir):
    return graph.reference_view(fx.edges(spark, sf_dir))


_STRONG = "overlap = 45 and quality >= 0.3"


@query(f"with recursive g as (select src, dst from fx_edges where {_STRONG} union select dst, src from fx_edges where {_STRONG}), reach(a, b) as (select view_id, view_id from fx_views union select r.a, g.dst from reach r join g on r.b = g.src) select a as view_id, min(b) as component from reach group by a")
def connected_components(spark, sf_dir):
    return graph.components(fx.views(spark, sf_dir), fx.edges(spark, sf_dir).where(_STRONG))


@query()
def prune_shortest_paths(spark, sf_dir):
    return graph.prune_shortest_paths(fx.edges(spark, sf_dir), fx.views(spark, sf_dir))


@query()
def prune_alternating(spark, sf_dir):
    return graph.prune_alternating(fx.edges(spark, sf_dir), fx.views(spark, sf_dir))


# Resolution of transforms.
def true_edges(spark, sf_dir) -> DataFrame:
    """Edges whose transforms agree with the registered placement."""
    e, v = fx.edges(spark, sf_dir), fx.views(spark, sf_dir)
    at = lambda p, k: v.select(F.col("view_id").alias(k), (F.col("ry") - F.col("oy")).alias(f"{p}y"), (F.col("rx") - F.col("ox")).alias(f"{p}x"))
    both = e.join(at("a", "src"), "src").join(at("b", "dst"), "dst")
    return resolve.translation_edges(both, [F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")], (["lo_y", "lo_x"], ["hi_y", "hi_x"]))


def made_edges(spark, sf_dir) -> DataFrame:
    return resolve.translation_edges(fx.edges(spark, sf_dir), [F.col("dy"), F.col("dx")], (["lo_y", "lo_x"], ["hi_y", "hi_x"]))


@query("select src, dst, cast(2 * k + l as int) as corner, cast(case when k = 0 then lo_y else hi_y end as double) as p_y, cast(case when l = 0 then lo_x else hi_x end as double) as p_x, cast((case when k = 0 then lo_y else hi_y end) + dy as double) as q_y, cast((case when l = 0 then lo_x else hi_x end) + dx as double) as q_x from fx_edges, (select unnest([0, 1]) as k) a, (select unnest([0, 1]) as l) b")
def virtual_beads(spark, sf_dir):
    beads = resolve.virtual_beads(made_edges(spark, sf_dir), 2)
    return beads.select("src", "dst", F.col("corner").cast("int").alias("corner"), *(F.get(c, F.lit(d)).alias(f"{c}_{a}") for c in "pq" for d, a in enumerate("yx")))


@query("select e.src, e.dst, round(sqrt(pow(a.ry - a.oy - (b.ry - b.oy) - dy, 2) + pow(a.rx - a.ox - (b.rx - b.ox) - dx, 2)), 6) as rms from fx_edges e join fx_views a on a.view_id = e.src join fx_views b on b.view_id = e.dst")
def edge_residuals(spark, sf_dir):
    params = fx.views(spark, sf_dir).select("view_id", affine.translation([F.col("ry") - F.col("oy"), F.col("rx") - F.col("ox")]).alias("affine"))
    return resolve.edge_residuals(resolve.virtual_beads(made_edges(spark, sf_dir), 2), params, 2).withColumn("rms", F.round("rms", 6))


#: Placement relative to each component's reference view, whose transform is the identity.
_REFERENCE = """with recursive g as (select src, dst from fx_edges union select dst, src from fx_edges), reach(a, b) as (select view_id, view_id from fx_views union select r.a, g.dst from reach r join g on r.b = g.src),
    c as (select a as view_id, min(b) as component, count(*) as members from reach group by a), q as (select view_id, sum(quality) as total from (select src as view_id, quality from fx_edges union all select dst, quality from fx_edges) group by view_id),
    o as (select c.*, row_number() over (partition by component order by case when members = 2 then 0 else -round(coalesce(total, 0), 9) end, c.view_id) as k from c left join q on q.view_id = c.view_id),
    f as (select component, v.ry - v.oy as fy, v.rx - v.ox as fx from o join fx_views v on v.view_id = o.view_id where k = 1)
    select v.view_id, cast(0 as int) as t, round(cast(v.ry - v.oy - fy as double), 4) + 0.0 as ty, round(cast(v.rx - v.ox - fx as double), 4) + 0.0 as tx from fx_views v join c on c.view_id = v.view_id join f on f.component = c.component"""


def _resolved(spark, sf_dir, method: str, **options) -> DataFrame:
    out = resolve.resolve(true_edges(spark, sf_dir), fx.views(spark, sf_dir), 2, method, **options)
    return out.select("view_id", "t", *((F.round(F.get("affine", F.lit(i)), 4) + 0.0).alias(k) for i, k in ((2, "ty"), (5, "tx"))))


for _method, _options in (("shortest_paths", {}), ("linear_two_pass", {}), ("global_optimization", {"rel_tol": 1e-9, "max_iter": 5000})):
    query(_REFERENCE, f"resolve_{_method}")(partial(_resolved, method=_method, **_options))


# Interpolated resampling.
_SHIFT = "o as (select view_id, oy + 0.25 * (view_id % 4) as o_y, ox + 0.5 * (view_id % 2) as o_x from fx_views)"
_LINEAR = f"""{_SHIFT}, b as (select p.*, ceil(o_y) as sy, ceil(o_x) as sx, ceil(o_y) - o_y as py, ceil(o_x) - o_x as px from fx_pixels p join o on o.view_id = p.view_id),
    s as (select view_id, v, y + sy - k as wy, x + sx - l as wx, (case when k = 1 then py else 1 - py end) * (case when l = 1 then px else 1 - px end) as share from b, (select unnest([0, 1]) as k) a, (select unnest([0, 1]) as l) c),
    r as (select view_id, cast(wy as bigint) as wy, cast(wx as bigint) as wx, sum(v * share) as v, sum(share) as al from s where share > 0 group by 1, 2, 3)"""


def _linear(spark, sf_dir) -> DataFrame:
    v = fx.views(spark, sf_dir)
    moved = v.select("view_id", (F.col("oy") + 0.25 * (F.col("view_id") % 4)).alias("o_y"), (F.col("ox") + 0.5 * (F.col("view_id") % 2)).alias("o_x"))
    return resample.shift_linear(fx.pixels(spark, sf_dir), moved, ["view_id"], ["y", "x"])


@query(f"with {_LINEAR} select view_id, wy, wx, round(v, 6) as v from r where al > 1 - 1e-9")
def resample_linear(spark, sf_dir):
    return _linear(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(f"with {_LINEAR} select wy, wx, round(avg(v), 6) as vavg, count(*) as n from r where al > 1 - 1e-9 group by wy, wx")
def fuse_fractional_shift(spark, sf_dir):
    return fusion.fuse(_linear(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", F.round("vavg", 6).alias("vavg"), "n")


# Registration.
def _registered(spark, sf_dir) -> DataFrame:
    edges = overlap.overlaps(fx.levels(spark, sf_dir), fx.transforms(spark, sf_dir), 2, 16.0)
    pixels = world(spark, sf_dir).select("view_id", F.lit(0).alias("t"), F.col("wy").alias("y"), F.col("wx").alias("x"), "v")
    return register.register_pairs(edges, pixels, ["y", "x"]).join(edges.select("src", "dst", "overlap"), ["src", "dst"])


@query()
def phase_correlation(spark, sf_dir):
    return _registered(spark, sf_dir).select("src", "dst", "t", F.round(F.get("transform", F.lit(2)), 4).alias("ty"), F.round(F.get("transform", F.lit(5)), 4).alias("tx"), F.round("quality", 6).alias("quality"))


@query(name="register")
def register_views(spark, sf_dir):
    out = resolve.resolve(_registered(spark, sf_dir), fx.views(spark, sf_dir), 2, "linear_two_pass", transform="translation")
    return out.select("view_id", "t", F.round(F.get("affine", F.lit(2)), 4).alias("ty"), F.round(F.get("affine", F.lit(5)), 4).alias("tx"))


# Markers.
_NEAR = "n as (select a.view_id, a.point_id, b.point_id as other, row_number() over (partition by a.point_id order by pow(a.py - b.py, 2) + pow(a.px - b.px, 2), b.point_id) as k, a.py, a.px, b.py as qy, b.px as qx from fx_points a join fx_points b on a.view_id = b.view_id and a.point_id <> b.point_id)"
_DIST = lambda a, b: f"sqrt(pow({a}y - {b}y, 2) + pow({a}x - {b}x, 2))"
_TRIPLES = f"""{_NEAR}, w as (select view_id, point_id, any_value(py) as py, any_value(px) as px, count(*) as n, {", ".join(f"max(case when k = {k} then q{c} end) as n{k}{c}" for k in range(1, 5) for c in "yx")} from n where k <= 4 group by 1, 2),
    d as (select view_id, point_id, combo, list_sort(list) as descriptor from (select view_id, point_id, unnest([{", ".join("{'combo': " + str(c) + ", 'list': [" + ", ".join(_DIST(a, b) for a, b in (("p", f"n{s[0]}"), ("p", f"n{s[1]}"), ("p", f"n{s[2]}"), (f"n{s[0]}", f"n{s[1]}"), (f"n{s[0]}", f"n{s[2]}"), (f"n{s[1]}", f"n{s[2]}"))) + "]}" for c, s in enumerate(((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4))))}], recursive := true) from w where n >= 4))"""


def _descriptors(spark, sf_dir) -> DataFrame:
    return markers.descriptors(fx.points(spark, sf_dir), 3, 1, ["py", "px"])


@query(f"with {_TRIPLES} select view_id, point_id, cast(combo as int) as combo, round(descriptor[1], 5) as d0, round(descriptor[6], 5) as d5, round(list_sum(descriptor), 5) as total from d")
def marker_descriptors(spark, sf_dir):
    total = F.aggregate("descriptor", F.lit(0.0), lambda s, x: s + x)
    return _descriptors(spark, sf_dir).select("view_id", "point_id", "combo", F.round(F.get("descriptor", F.lit(0)), 5).alias("d0"), F.round(F.get("descriptor", F.lit(5)), 5).alias("d5"), F.round(total, 5).alias("total"))


@query(
    f"""with {_TRIPLES}, x as (select e.src, e.dst, a.point_id as fixed, a.combo as ca, b.point_id as moving, min(sqrt(list_sum(list_transform(list_zip(a.descriptor, b.descriptor), lambda z: pow(z[1] - z[2], 2))))) as d from fx_edges e join d a on a.view_id = e.src join d b on b.view_id = e.dst group by 1, 2, 3, 4, 5),
    r as (select *, row_number() over (partition by src, dst, fixed, ca order by d, moving) as k, lead(d) over (partition by src, dst, fixed, ca order by d, moving) as second from x where d <= 10) select src, dst, fixed, moving, round(min(d), 5) as distance from r where k = 1 and d <= 2 and (second is null or d * 1.2 < second) group by 1, 2, 3, 4"""
)
def marker_matches(spark, sf_dir):
    d = _descriptors(spark, sf_dir)
    pairs = fx.edges(spark, sf_dir).select("src", "dst")
    side = lambda end: pairs.join(d, F.col(end) == F.col("view_id")).drop("view_id")
    found = markers.matches(side("src"), side("dst"), 1.2, 2.0, by=("src", "dst"))
    return found.withColumn("distance", F.round("distance", 5))


@query()
def marker_registration(spark, sf_dir):
    """Points of each view against the same points turned and moved."""
    p = fx.points(spark, sf_dir).select(F.col("view_id").cast("long").alias("view_id"), "point_id", "py", "px")
    c, s = 0.995004165, 0.099833417
    moved = p.select((F.col("view_id") + 1000).alias("view_id"), "point_id", (c * F.col("py") - s * F.col("px") + 1.5).alias("py"), (s * F.col("py") + c * F.col("px") - 2.0).alias("px"))
    edges = p.select(F.col("view_id").alias("src"), (F.col("view_id") + 1000).alias("dst")).distinct()
    pairs = p.select(F.col("view_id").alias("src"), (F.col("view_id") + 1000).alias("dst"), F.col("point_id").alias("fixed"), F.col("point_id").alias("moving"))
    out = markers.register_points(edges, p.unionByName(moved), pairs, ["py", "px"], "rigid", 0.5)
    return out.select("src", "dst", F.transform("transform", lambda x: F.round(x, 4)).alias("transform"), F.round("quality", 4).alias("quality"))


# Neighbourhood operators.
@query()
def log_detect(spark, sf_dir):
    return blocks.detect(fx.pixels(spark, sf_dir), ["view_id"], ["y", "x"], 3.0, threshold_abs=4.0)


def _world_views(spark, sf_dir) -> DataFrame:
    return weighted(spark, sf_dir).select("view_id", F.col("wy").alias("y"), F.col("wx").alias("x"), "v", "w")


for _name, _method, _options in (("fuse_content_based", "content", {"sigma_1": 1.0, "sigma_2": 2.0}), ("fuse_dct", "dct", {}), ("fuse_deconvolution", "deconvolution", {"sigma": 0.8})):
    query(name=_name)(lambda spark, sf_dir, m=_method, o=_options: blocks.fuse_blocks(_world_views(spark, sf_dir), ["y", "x"], m, **o).withColumn("fused", F.round("fused", 6)))


@query("select oy + x as y, ox + 15 - y as x, max(v) as fused from fx_pixels p join fx_views w on p.view_id = w.view_id group by 1, 2")
def fuse_affine(spark, sf_dir):
    """Every view turned by a quarter before it is placed."""
    from tessera.plans import pipelines

    turned = F.array(F.lit(0.0), F.lit(1.0), F.col("oy").cast("double"), F.lit(-1.0), F.lit(0.0), F.col("ox").cast("double") + 15.0, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return pipelines.fuse_views(fx.pixels(spark, sf_dir), fx.views(spark, sf_dir).select("view_id", turned.alias("affine")), (EDGE, EDGE), "max")


# Set operations and transforms.
@query("select view_id, y, x, v, 'a' as c from fx_pixels union all select view_id, y, x, v + 1, 'b' from fx_pixels where view_id % 2 = 0")
def concat_channels(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    return combine.concat([p.withColumn("c", F.lit("a")), p.where("view_id % 2 = 0").withColumn("v", F.col("v") + 1).withColumn("c", F.lit("b"))], "c")


@query("select view_id, y, x, v, 0 as t from fx_pixels  union all select view_id, y, x, v, 1 from fx_pixels  union all select view_id, y, x, v, 2 from fx_pixels ")
def stack_time(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    return combine.stack([p, p, p], "t")


@query("select view_id, y + 0 as y, x, v from fx_pixels union all select view_id, y + 16, x, v + 1 from fx_pixels")
def concat_axis(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    return combine.concat([p, p.withColumn("v", F.col("v") + 1)], "y", [EDGE, EDGE])


@query("select 'stage' as transform_key, view_id, cast(oy as double) as ty from fx_views union all select 'registered', view_id, cast(ry as double) from fx_views where view_id % 2 = 0")
def upsert_transforms(spark, sf_dir):
    key = lambda k, t: t.select(F.lit(k).alias("transform_key"), "view_id", F.lit(None).cast("int").alias("t"), F.lit(None).cast("string").alias("c"), "affine")
    old = key("stage", fx.transforms(spark, sf_dir))
    registered = fx.transforms(spark, sf_dir, "registered")
    new = key("stage", registered).unionByName(key("registered", registered.where("view_id % 2 = 0")))
    return combine.upsert(old, new).select("transform_key", "view_id", F.get("affine", F.lit(2)).alias("ty"))


# Clustering and labels.
@query("with r as (select view_id, cast(oy as double) as y from fx_views), g as (select *, case when y - lag(y) over (order by y, view_id) > 1 then 1 else 0 end as b from r) select view_id, y, cast(sum(b) over (order by y, view_id rows unbounded preceding) as bigint) as cluster from g")
def group_views_1d(spark, sf_dir):
    from tessera.operators.cluster import gaps

    return gaps(fx.views(spark, sf_dir).select("view_id", F.col("oy").cast("double").alias("y")), "y", "view_id", 1.0)


@query("with l as (select view_id, y, x, cast(v as bigint) % 4 as label from fx_pixels), s as (select unnest([[0, 1], [1, 0]]) as d) select distinct a.view_id, a.label - 1 as a, b.label - 1 as b from l a, s, l b where a.view_id = b.view_id and b.y = a.y + s.d[1] and b.x = a.x + s.d[2] and a.label <> 0 and b.label <> 0 and a.label <> b.label")
def label_adjacency(spark, sf_dir):
    labels = fx.pixels(spark, sf_dir).select("view_id", "y", "x", (F.col("v").cast("long") % 4).alias("label"))
    return overlap.neighbour_labels(labels, ["y", "x"], by=("view_id",))


# Frames, channels and viewers.
@query("select t, w.oy + p.y as wy, w.ox + p.x as wx, max(v) as vmax, round(avg(v), 6) as vavg, count(*) as n from fx_timelapse p join fx_views w on p.view_id = w.view_id group by 1, 2, 3")
def fuse_timelapse(spark, sf_dir):
    placed = fusion.placed(fx.timelapse(spark, sf_dir), offsets(spark, sf_dir), ["y", "x"])
    return fusion.fuse(placed, ["t", "wy", "wx"]).withColumn("vavg", F.round("vavg", 6))


@query("select case when view_id % 2 = 0 then 'even' else 'odd' end as c, min(v) as start, max(v) as \"end\" from fx_pixels group by 1")
def contrast_window(spark, sf_dir):
    channels = fx.pixels(spark, sf_dir).withColumn("c", F.when(F.col("view_id") % 2 == 0, "even").otherwise("odd"))
    return viewer.contrast_window(channels)


@query("select view_id, cast(oy / 0.5 as double) as ty, cast(ox / 0.25 as double) as tx from fx_views")
def viewer_transforms(spark, sf_dir):
    moved = viewer.source_transforms(fx.transforms(spark, sf_dir), [0.5, 0.25])
    return moved.select("view_id", F.get("affine", F.lit(2)).alias("ty"), F.get("affine", F.lit(5)).alias("tx"))


@query("select view_id, 2 as ndim, oy as a02, ox as a12, cast(1 as bigint) as a22, cast(0 as bigint) as a03 from fx_views")
def expand_affine_dims(spark, sf_dir):
    """Affines of two dimensions as ones of three."""
    wide = affine.with_axes(F.col("affine"), 2, 3)
    return fx.transforms(spark, sf_dir).select("view_id", F.lit(2).alias("ndim"), F.get(wide, F.lit(7)).cast("long").alias("a02"), F.get(wide, F.lit(11)).cast("long").alias("a12"), F.get(wide, F.lit(0)).cast("long").alias("a22"), F.get(wide, F.lit(3)).cast("long").alias("a03"))


@query("select view_id, cast(oy + 7.5 as double) as cy, cast(ox + 7.5 as double) as cx from fx_views")
def view_centres(spark, sf_dir):
    at = affine.apply(F.col("affine"), affine.literal((7.5, 7.5)), 2)
    return fx.transforms(spark, sf_dir).select("view_id", F.get(at, F.lit(0)).alias("cy"), F.get(at, F.lit(1)).alias("cx"))


@query("select view_id, k as corner, cast(oy + 15 * (k // 2) as double) as wy, cast(ox + 15 * (k % 2) as double) as wx from fx_views, (select unnest([0, 1, 2, 3]) as k) c")
def view_corners(spark, sf_dir):
    spots = F.array(*geometry.corners(F.col("shape"), F.col("spacing"), F.col("origin"), 2))
    both = fx.levels(spark, sf_dir).join(fx.transforms(spark, sf_dir), "view_id").select("view_id", "affine", F.posexplode(spots).alias("corner", "p"))
    world_ = affine.apply(F.col("affine"), F.col("p"), 2)
    return both.select("view_id", "corner", F.get(world_, F.lit(0)).alias("wy"), F.get(world_, F.lit(1)).alias("wx"))


@query("select view_id, y, x, v from fx_pixels where v <> 0", name="scan_chunks")
def scan_chunks(spark, sf_dir):
    """A round trip of every view through chunked images: zero pixels are not told from missing ones and are left out."""
    from tessera.sources import store

    return store.round_trip(fx.pixels(spark, sf_dir).where("v <> 0"), EDGE)


@query("with l as (select view_id, label, count(*) as n, avg(y) as cy, avg(x) as cx from (select view_id, cast(v as bigint) % 7 as label, y, x from fx_pixels) q where label <> 0 group by view_id, label) select view_id, label, n, round(cy, 6) as cy, round(cx, 6) as cx from l where cy >= 4 and cy < 12 and cx >= 4 and cx < 12")
def label_centroids(spark, sf_dir):
    labels = fx.pixels(spark, sf_dir).select("view_id", (F.col("v").cast("long") % 7).alias("label"), "y", "x")
    found = blocks.label_centroids(labels, ["y", "x"], [4, 4], [8, 8], by=("view_id",))
    return found.select("view_id", "label", "n", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


@query("select src as view_id, count(*) as links, round(avg(quality), 6) as quality from (select src, quality from fx_edges union all select dst, quality from fx_edges) group by 1")
def view_links(spark, sf_dir):
    ends = fx.edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("view_id"), "quality")
    return ends.groupBy("view_id").agg(F.count("*").alias("links"), F.round(F.avg("quality"), 6).alias("quality"))


@query()
def fuse_holes_filled(spark, sf_dir):
    """The fused maximum with holes of up to three pixels taking their nearest neighbour's value."""
    fused = fusion.fuse(world(spark, sf_dir), ["wy", "wx"]).select("wy", "wx", "vmax")
    grid = fx.views(spark, sf_dir).select(F.explode(F.sequence(F.col("oy"), F.col("oy") + 15)).alias("wy"), "ox").select("wy", F.explode(F.sequence(F.col("ox"), F.col("ox") + 15)).alias("wx")).distinct()
    return blocks.fill_holes(fused, grid, ["wy", "wx"], "vmax", 3)


@query(
    f"""with l as (select wy, wx, min(view_id) as label from ({_WORLD}) q where v > 25 group by wy, wx), s as (select unnest([[0, 1], [1, 0]]) as d)
    select distinct least(a.label, b.label) as src, greatest(a.label, b.label) as dst from l a, s, l b where b.wy = a.wy + s.d[1] and b.wx = a.wx + s.d[2] and a.label <> b.label"""
)
def mask_pairs(spark, sf_dir):
    masks = world(spark, sf_dir).where("v > 25").select("view_id", "wy", "wx", "v")
    return overlap.mask_pairs(masks, ["wy", "wx"])


@query("select min(oy) * 1.0 as o_y, min(ox) * 1.0 as o_x, 0.5 as s_y, 0.5 as s_x, cast(floor((max(oy + 15 * (0.5 + 0.5 * (view_id % 2))) - min(oy)) / 0.5 + 1e-9) + 1 as int) as n_y, cast(floor((max(ox + 15 * (0.5 + 0.5 * (view_id % 2))) - min(ox)) / 0.5 + 1e-9) + 1 as int) as n_x from fx_views".replace("* 1.0 as", "* cast(1 as double) as").replace("0.5 as s", "cast(0.5 as double) as s"))
def combine_stacks(spark, sf_dir):
    v = fx.views(spark, sf_dir)
    space = 0.5 + 0.5 * (F.col("view_id") % 2)
    stacks = v.select(F.array(F.col("oy").cast("double"), F.col("ox").cast("double")).alias("origin"), F.array(space, space).alias("spacing"), F.array(F.lit(EDGE), F.lit(EDGE)).alias("shape"))
    out = plan.combined(stacks, 2)
    return out.select(*(F.get(c, F.lit(d)).alias(f"{k}_{a}") for c, k in (("origin", "o"), ("spacing", "s"), ("shape", "n")) for d, a in enumerate("yx")))


def _mean_gap(a, b) -> float:
    return abs(a - b).mean()


@query(f"with {_PAIRS} select src, dst, 'mean_gap' as metric, round(avg(abs(a - b)), 6) as value from p group by src, dst")
def metric_functions(spark, sf_dir):
    return metrics.custom(_pair_pixels(spark, sf_dir), {"mean_gap": _mean_gap}, ["wy", "wx"]).withColumn("value", F.round("value", 6))


def _largest(transformed_views):
    import warnings

    import numpy as np

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmax(transformed_views, axis=0)


@query(f"select wy as y, wx as x, max(v) as fused from ({_WORLD}) q group by wy, wx")
def fuse_with_function(spark, sf_dir):
    return blocks.fuse_with(_world_views(spark, sf_dir), ["y", "x"], _largest)
