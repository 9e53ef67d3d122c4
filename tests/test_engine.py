"""Operators end to end: affine algebra, sources, registration of synthetic tiles, fusion, streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import affine, kernels
from tessera.operators import combine, graph, overlap, pyramid, register, resolve, selection
from tessera.plans import pipelines
from tessera.sources import synthetic, tiff, zarr
from tessera.streaming import incremental


def _row(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_affine_3d(spark):
    m = affine.rotation_3d(0.7, (1.0, 2.0, 0.5))
    m[3], m[7], m[11] = 1.0, -2.0, 3.0
    a = affine.literal(m)
    row = _row(spark, affine.multiply(a, affine.invert(a, 3), 3).alias("i"), affine.apply(a, affine.literal((1, 2, 3)), 3).alias("p"), affine.without_axis(a, 3, 0).alias("w"), affine.with_axes(affine.identity(2), 2, 3).alias("e"), affine.reverse_axes(affine.reverse_axes(a, 3), 3).alias("r"))
    full = np.array(m).reshape(4, 4)
    assert np.allclose(row["i"], np.eye(4).ravel())
    assert np.allclose(row["p"], (full @ [1, 2, 3, 1])[:3])
    assert np.allclose(row["w"], full[1:, 1:].ravel())
    assert np.allclose(row["e"], np.eye(4).ravel()) and np.allclose(row["r"], m)


def test_singular_affine_has_no_inverse(spark):
    assert _row(spark, affine.invert(affine.literal([0] * 8 + [1]), 2).alias("i"))["i"] is None


def _levels(spark, shapes):
    return spark.createDataFrame([(k, list(s), [1.0] * len(s), [0.0] * len(s)) for k, s in enumerate(shapes)], "view_id long, shape array<int>, spacing array<double>, origin array<double>")


@pytest.mark.parametrize("shared,volume", [(0, None), (1, None), (3, 2 * 14 * 14)])
def test_overlap_3d_needs_a_volume(spark, shared, volume):
    levels = _levels(spark, [(15, 15, 15)] * 2)
    moved = spark.createDataFrame([(0, np.eye(4).ravel().tolist()), (1, (np.eye(4) + [[0, 0, 0, 15.0 - shared], [0] * 4, [0] * 4, [0] * 4]).ravel().tolist())], "view_id long, affine array<double>")
    for found in (overlap.overlaps(levels, moved, 3, 7.0), overlap.rotated(levels, moved, 3, 7.0)):
        rows = found.collect()
        assert [round(r["overlap"], 6) for r in rows] == ([] if volume is None else [volume])


def test_validate(spark):
    with pytest.raises(ValueError, match="view_id"):
        schema.validate(spark.range(1), schema.VIEWS)
    views = spark.createDataFrame([(0, "a", 2, "uint8", None, None, None), (1, "b", 3, "uint8", None, None, None)], schema.VIEWS)
    with pytest.raises(ValueError, match="different"):
        schema.check_compatible(views)


def test_selections(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, float("nan"), 2.0), (3, 5.0, 2.0), (4, None, 1.0)], "point_id long, py double, px double")
    found = selection.select_points(points, {"y": (1.0, 4.0)}, {"y": "py", "x": "px"}).collect()
    assert [r["point_id"] for r in found] == [1]


def test_pyramid_levels():
    levels = pyramid.resolution_levels({"z": 90, "y": 1000, "x": 250})
    assert [v["shape"] for v in levels] == [{"z": 90, "y": 1000, "x": 250}, {"z": 90, "y": 500, "x": 125}, {"z": 90, "y": 250, "x": 125}, {"z": 90, "y": 125, "x": 125}]
    assert pyramid.level_for_binning([{"y": 1, "x": 1}, {"y": 2, "x": 2}, {"y": 4, "x": 4}], {"y": 4, "x": 6}) == (1, {"y": 2, "x": 3})
    assert register.binning({"y": 1000, "x": 1000}, {"y": 1.0, "x": 1.0}, 300_000) == {"y": 2, "x": 2}


def test_method_arguments_choose_the_space():
    assert register.space_of(lambda fixed, moving: None) == "pixel"
    assert register.space_of(lambda fixed_points, moving_points: None) == "points"
    with pytest.raises(ValueError):
        register.space_of(lambda fixed, moving, fixed_origin: None)
    with pytest.raises(TypeError):
        resolve.register_resolver("bad", 3)


def test_pruning_names(spark):
    none = spark.createDataFrame([], "src long, dst long, overlap double")
    with pytest.raises(graph.NotEnoughOverlapError):
        graph.prune(none, spark.range(2).withColumnRenamed("id", "view_id"), None)
    with pytest.raises(ValueError):
        graph.prune(spark.createDataFrame([(0, 1, 2.0)], none.schema), spark.range(2).withColumnRenamed("id", "view_id"), "best")


def test_alternating_colours(spark):
    ring = spark.createDataFrame([(0, 1, 9.0), (1, 2, 9.0), (0, 2, 1.0)], "src long, dst long, overlap double")
    left = graph.prune_alternating(ring, spark.range(3).withColumnRenamed("id", "view_id")).collect()
    assert sorted((r["src"], r["dst"]) for r in left) == [(0, 1), (1, 2)]


def test_combining(spark):
    a = spark.createDataFrame([(0, 1.0)], "y long, v double")
    with pytest.raises(ValueError):
        combine.stack([a, a], "y")
    assert sorted(r["y"] for r in combine.concat([a, a], "y", [4, 4]).collect()) == [0, 4]
    assert combine.chunk_aligned([8, 8, 3], 4) and not combine.chunk_aligned([6, 8], 4)


def test_register_and_fuse_synthetic_tiles(spark):
    tiling = synthetic.Tiling((2, 3), 40, 14, shift=2.0, seed=5)
    pixels = synthetic.tiles(spark, tiling).persist()
    truth = tiling.views().set_index("view_id")
    levels = _levels(spark, [(40, 40)] * 6)
    stage = spark.createDataFrame([(int(v), [1.0, 0.0, float(r.o_y), 0.0, 1.0, float(r.o_x), 0.0, 0.0, 1.0]) for v, r in truth.iterrows()], "view_id long, affine array<double>")
    for resolver in ("global_optimization", "linear_two_pass", "shortest_paths"):
        params, edges = pipelines.register_views(levels, stage, pixels, pipelines.RegistrationOptions(cell=40.0, resolver=resolver, pruning="keep_axis_aligned", resolver_options={} if resolver != "linear_two_pass" else {"transform": "translation"}))
        found = {r["view_id"]: np.array([r["affine"][2], r["affine"][5]]) for r in params.collect()}
        want = {v: np.array([r.s_y, r.s_x]) for v, r in truth.iterrows()}
        for v in want:
            assert np.abs((found[v] - found[0]) - (want[v] - want[0])).max() < 0.6, (resolver, v)
        assert edges.where("quality > 0.8").count() == edges.count()
    exact = spark.createDataFrame([(int(v), [1.0, 0.0, float(r.o_y + r.s_y), 0.0, 1.0, float(r.o_x + r.s_x), 0.0, 0.0, 1.0]) for v, r in truth.iterrows()], "view_id long, affine array<double>")
    image, m = tiling.truth(), tiling.margin()
    for method in ("max", "simple_average", "weighted_average"):
        for r in pipelines.fuse_views(pixels, exact, (40, 40), method).sample(0.1, seed=1).collect():
            assert abs(r["fused"] - image[r["y"] + m, r["x"] + m]) < 1e-6
    half = exact.withColumn("affine", F.transform("affine", lambda x, i: F.when(i == 2, x + 0.5).otherwise(x)))
    for r in pipelines.fuse_views(pixels, half, (40, 40)).sample(0.05, seed=1).collect():
        y, x = r["y"] + m, r["x"] + m
        assert abs(r["fused"] - (image[y - 1, x] + image[y, x]) / 2) < 1e-6


def test_blocks_do_not_matter(spark):
    from tessera.operators import blocks

    image = np.zeros((70, 70))
    for y, x in ((10, 12), (33, 31), (31, 60), (64, 32)):
        image[y, x] = 200
    image = kernels.gaussian(image, 1.0)
    y, x = np.indices(image.shape)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"view_id": 0, "y": y.ravel(), "x": x.ravel(), "v": image.ravel(), "w": 1.0}))
    found = [sorted((r["y"], r["x"]) for r in blocks.detect(rows, ["view_id"], ["y", "x"], 3.0, b, threshold_abs=2.0).collect()) for b in (32, 128)]
    assert found[0] == found[1] == [(10, 12), (31, 60), (33, 31), (64, 32)]
    fused = [blocks.fuse_blocks(rows, ["y", "x"], "content", b, sigma_1=1.0, sigma_2=2.0).orderBy("y", "x").toPandas()["fused"] for b in (32, 128)]
    assert np.allclose(fused[0], fused[1])


def test_zarr_round_trip(spark, tmp_path):
    y, x = np.indices((20, 30))
    import pandas as pd

    v = (y * 31 + x) % 251
    rows = pd.concat([pd.DataFrame({"level": 0, "y": y.ravel(), "x": x.ravel(), "v": v.ravel()}), pd.DataFrame({"level": 1, "y": y[:10, :15].ravel(), "x": x[:10, :15].ravel(), "v": v[::2, ::2].ravel()})])
    path = str(tmp_path / "a.zarr")
    levels = [{"shape": [20, 30], "chunk": [8, 16], "scale": [0.5, 0.5], "translation": [1.0, 2.0]}, {"shape": [10, 15], "chunk": [8, 16], "scale": [1.0, 1.0], "translation": [1.25, 2.25]}]
    zarr.write(spark.createDataFrame(rows), path, levels)
    spark.dataSource.register(zarr.OmeZarr)
    found = zarr.pixels(spark.read.format("ome_zarr").option("level", 0).option("view_id", 7).load(path), 2).toPandas()
    assert len(found) == 600 and (found["view_id"] == 7).all()
    assert (found["v"] == (found["y"] * 31 + found["x"]) % 251).all()
    zarr.set_translation(path, [10.0, 0.0])
    table = zarr.levels(spark, path).orderBy("level").collect()
    assert table[1]["spacing"] == [1.0, 1.0] and table[0]["origin"] == [11.0, 2.0]
    with pytest.raises(Exception, match="no level"):
        spark.read.format("ome_zarr").option("level", 5).load(path).count()


def test_tiff_round_trip(spark, tmp_path):
    images = [np.arange(12, dtype=np.uint16).reshape(3, 4) + k for k in range(3)]
    assert tiff.write(str(tmp_path / "a.tif"), iter(images), (0.5, 0.5)) == 3
    rows = tiff.read(spark, str(tmp_path)).orderBy("page").collect()
    assert [np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]).tolist() for r in rows] == [i.tolist() for i in images]
    with pytest.raises(ValueError):
        tiff.pages(b"II*\0nothing")


def test_streamed_fusion(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0, 5.0), (1, 0, 0, 7.0), (0, 1, 1, 2.0)], "view_id long, y long, x long, v double")
    rows.write.parquet(str(tmp_path / "in"))
    offsets = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "view_id long, o_y long, o_x long")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = incremental.fuse_stream(stream, offsets).writeStream.outputMode("complete").format("memory").queryName("fused").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["wy"], r["wx"]): (r["vmax"], r["n"]) for r in spark.table("fused").collect()} == {(0, 0): (7.0, 2), (1, 1): (2.0, 1)}


def test_resampling_by_any_affine(spark):
    """Smooth views that are turned, scaled, in two and three dimensions, against the function that made them."""
    import numpy as np

    from tessera.operators.resample import resample_affine

    for n in (2, 3):
        dims, edge = ["z", "y", "x"][-n:], 12
        plane = lambda at: 5.0 + at @ np.arange(1.0, at.shape[-1] + 1)
        spots = np.argwhere(np.ones((edge,) * n))
        rows = [(v, *map(int, s), float(plane(s.astype(float))), 1.0) for v in (1, 2) for s in spots]
        pixels = spark.createDataFrame(rows, "view_id long, " + ", ".join(f"{d} long" for d in dims) + ", v double, w double")
        c, s_ = np.cos(0.3), np.sin(0.3)
        matrix = np.eye(n + 1)
        matrix[n - 2 : n, n - 2 : n] = [[c, -s_], [s_, c]]
        matrix[:n, n] = np.arange(n) + 0.25
        scaled = np.diag([1.5] * n + [1.0])
        transforms = spark.createDataFrame([(1, matrix.ravel().tolist()), (2, scaled.ravel().tolist())], "view_id long, affine array<double>")
        found = resample_affine(pixels, transforms, dims, ["v", "w"]).collect()
        assert {r["view_id"] for r in found} == {1, 2} and len([r for r in found if r["view_id"] == 2]) == 17**n
        for r in found[:: 1 + len(found) // 200]:
            back = np.linalg.inv(matrix if r["view_id"] == 1 else scaled)
            at = (back @ [*(r[f"w{d}"] for d in dims), 1.0])[:n]
            assert abs(r["v"] - plane(at)) < 1e-6 and abs(r["w"] - 1) < 1e-9


@pytest.mark.parametrize("eps", [0.0, 0.5, 3.0])
def test_gaps_across_stretches(spark, eps):
    from tessera.operators.cluster import gaps

    rng = np.random.default_rng(3)
    values = np.r_[rng.uniform(0, 5000, 3000).round(1), rng.uniform(0, 10, 50), 1e6]
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(9999, None), (9998, float(values[0]))], "view_id long, at double")
    found = {r["view_id"]: r["cluster"] for r in gaps(rows, "at", "view_id", eps).collect()}
    ordered = np.unique(values)
    numbers = dict(zip(ordered.tolist(), np.r_[0, np.cumsum(np.diff(ordered) > eps)].tolist(), strict=True))
    assert found == {k: numbers[float(v)] for k, v in enumerate(values)} | {9998: numbers[float(values[0])]}


@pytest.mark.parametrize("values", [[], [2.0, 2.0], [None], [float("nan"), 1.0, 9.0]])
def test_gaps_of_few_values(spark, values):
    from tessera.operators.cluster import gaps

    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "view_id long, at double")
    found = {r["view_id"]: r["cluster"] for r in gaps(rows, "at", "view_id", 1.0).collect()}
    assert found == {0: {}, 2: {0: 0, 1: 0}, 1: {}, 3: {0: 2, 1: 0, 2: 1}}[len(values)]


def test_pair_pixels_are_bounded_before_they_meet(spark):
    from tessera.operators import metrics

    world = spark.createDataFrame([(v, y, float(10 * v + y)) for v in range(4) for y in range(8)], "view_id long, wy long, v double")
    edges = spark.createDataFrame([(0, 1, 2, 4), (1, 2, 6, 9), (3, 0, 0, 7), (0, 1, 2, 4)], "src long, dst long, lo long, hi long")
    found = {tuple(r) for r in metrics.pair_pixels(edges, world, ["wy"], bounds={"wy": ("lo", "hi")}).collect()}
    assert found == {(0, 1, y, float(y), 10.0 + y) for y in (2, 3, 4)} | {(1, 2, y, 10.0 + y, 20.0 + y) for y in (6, 7)}
    assert metrics.pair_pixels(edges, world, ["wy"]).count() == 16


def test_resolve_computes_its_edges_once(spark):
    from pyspark.sql import functions as F

    rows = [(a, a + 1, 1, 0.5, 4.0) for a in range(6)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(rows, "src long, dst long, t int, quality double, overlap double").mapInArrow(counted, "src long, dst long, t int, quality double, overlap double")
    box = lambda x: F.array(F.lit(x), F.lit(x))
    edges = edges.select("*", F.array(*(F.lit(x) for x in (1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))).alias("transform"), box(0.0).alias("bbox_lower"), box(2.0).alias("bbox_upper"))
    out = resolve.resolve(edges, spark.range(7).select(F.col("id").alias("view_id")), 2, "linear_two_pass", transform="translation")
    assert {r["view_id"]: round(r["affine"][2] - out.where("view_id = 0").first()["affine"][2], 6) for r in out.collect()} == {v: -float(v) for v in range(7)}
    assert seen.value == len(rows)


def test_marker_matches_of_many_points_make_no_square_of_rows(spark):
    """The ratio counts a second point beyond the limit, wherever its first entry lies; neighbours are found without a join."""
    from pyspark.sql import functions as F

    from tessera.operators import markers

    columns = "point_id long, combo int, descriptor array<double>"
    left = spark.createDataFrame([(1, 0, [3.9, 5.0]), (2, 0, [20.0, 21.0])], columns)
    right = spark.createDataFrame([(7, 0, [3.9, 7.0]), (8, 0, [6.1, 5.0]), (9, 0, [20.0, 21.0])], columns)
    assert [tuple(r) for r in markers.matches(left, right, 1.2, 2.0).collect()] == [(2, 9, 0.0)]
    points = spark.range(3000).select(F.lit(0).alias("view_id"), F.col("id").alias("point_id"), F.rand(1).alias("py"), F.rand(2).alias("px"))
    near = markers.neighbours(points, 4, ["py", "px"])
    assert near.count() == 12000 and "Join" not in near._jdf.queryExecution().executedPlan().toString()
