"""Saved images, chunk tables, viewer documents, and frames in the resolvers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import markers, resolve
from tessera.sources import store, viewer


def test_save_load_and_update(spark, tmp_path):
    eye = np.eye(3).ravel().tolist()
    transforms = spark.createDataFrame([("stage", 0, None, None, eye), ("stage", 1, None, None, eye)], schema.TRANSFORMS)
    pixels = spark.createDataFrame([(0, 0, 0, "0", None, 1, 2, 3.0), (0, 1, 0, "0", None, 0, 1, 4.0)], schema.PIXELS)
    store.save({"transforms": transforms, "pixels": pixels}, str(tmp_path / "i"))
    moved = [1.0, 0.0, 5.0, 0.0, 1.0, 6.0, 0.0, 0.0, 1.0]
    new = spark.createDataFrame([("stage", 1, None, None, moved), ("registered", 0, 0, None, moved)], schema.TRANSFORMS)
    for overwrite, want in ((False, eye), (True, moved)):
        store.update_transforms(spark, str(tmp_path / "i"), new, overwrite)
        found = store.load(spark, str(tmp_path / "i"))
        assert set(found) == {"transforms"}
        rows = {(r["transform_key"], r["view_id"]): r["affine"] for r in found["transforms"].collect()}
        assert rows["stage", 1] == want and rows["registered", 0] == moved and len(rows) == 3
    assert "level=1" in " ".join(p.name for p in (tmp_path / "i" / "pixels").iterdir())


def test_chunks_round_trip(spark):
    pixels = spark.createDataFrame([(0, 3, 17, 2.0), (0, 40, 1, 5.0), (1, 0, 0, 7.0)], "view_id long, y long, x long, v double")
    chunks = store.packed(pixels, 16)
    assert chunks.count() == 3
    schema.validate(chunks, schema.CHUNKS)
    assert sorted(map(tuple, store.unpacked(chunks).collect())) == sorted(map(tuple, pixels.collect()))


def test_viewer_state(spark):
    transforms = spark.createDataFrame([(0, [1.0, 0.0, 5.0, 0.0, 1.0, 6.0, 0.0, 0.0, 1.0])], "view_id long, affine array<double>")
    document = viewer.state({0: "zarr://http://host/a", 1: "zarr://http://host/b"}, transforms, ["y", "x"], [0.5, 2.0])
    assert document["layers"][0]["source"]["transform"]["matrix"] == [[1.0, 0.0, 10.0], [0.0, 1.0, 3.0]] and len(document["layers"]) == 1
    assert document["layout"] == "xy" and viewer.default_layout({"z": 9, "y": 9, "x": 1}) == "yz"
    assert viewer.address(document, "http://viewer/").startswith("http://viewer/#!%7B")


def test_plate(spark):
    views = spark.createDataFrame([(0, "a", 2, "uint8", "B", "1", "1"), (1, "b", 2, "uint8", "B", "1", "0"), (2, "c", 2, "uint8", None, None, None)], schema.VIEWS)
    rows = viewer.plate(views).collect()
    assert len(rows) == 1 and [f["view_id"] for f in rows[0]["fields"]] == [1, 0]


@pytest.mark.parametrize("method", ["shortest_paths", "linear_two_pass", "global_optimization"])
def test_frames_and_lonely_views(spark, method):
    move = lambda y: [1.0, 0.0, y, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, 1, t, move(float(t)), 0.9, 4.0, [0.0, 0.0], [4.0, 4.0]) for t in (0, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, t int, transform array<double>, quality double, overlap double, bbox_lower array<double>, bbox_upper array<double>")
    found = resolve.resolve(edges, spark.range(3).withColumnRenamed("id", "view_id"), 2, method)
    got = {(r["view_id"], r["t"]): round(r["affine"][2], 6) + 0.0 for r in found.collect()}
    assert got == {(0, 0): 0.0, (1, 0): 0.0, (2, 0): 0.0, (0, 1): 0.0, (1, 1): -1.0, (2, 1): 0.0}
    with pytest.raises(ValueError):
        resolve.resolve(edges, spark.range(3), 2, "guess")


def test_markers_end_to_end(spark):
    r = np.random.default_rng(4)
    fixed = r.uniform(0, 100, (40, 2))
    angle = 0.2
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    moving = fixed @ turn.T + [3, -7]
    rows = [(0, k, *map(float, p)) for k, p in enumerate(fixed)] + [(1, k, *map(float, p)) for k, p in enumerate(moving[5:])]
    points = spark.createDataFrame(rows, "view_id long, point_id long, py double, px double")
    d = markers.descriptors(points, 3, 1, ["py", "px"])
    pairs = markers.matches(d.where("view_id = 0"), d.where("view_id = 1"), 3.0, 1.0).select(F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), "fixed", "moving")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    out = markers.register_points(edges, points, pairs, ["py", "px"], "rigid", 0.5, icp=True).first()
    assert np.allclose(np.array(out["transform"]).reshape(3, 3)[:2, :2], turn, atol=1e-6) and out["quality"] > 0.9
    with pytest.raises(Exception, match="no transform"):
        markers.register_points(edges, points, pairs.limit(1), ["py", "px"], "affine", 0.5, fail_on_error=True).collect()


def test_contracts(spark):
    from tessera.functions import contracts
    from tessera.operators import blocks

    @contracts.requires_overlap(lambda o: 2 * o["reach"])
    @contracts.requires_source_shrinkage(lambda o: o["reach"] / 2)
    def weighted(transformed_views, fusion_weights, reach=3):
        return np.nansum(transformed_views * fusion_weights, axis=0)

    def first_only(transformed_views, blending_weights):
        return np.stack([np.ones(transformed_views.shape[1:]), *np.zeros((len(transformed_views) - 1, *transformed_views.shape[1:]))])

    assert contracts.halo_of([weighted, first_only], {}) == 6 and contracts.halo_of([weighted], {"reach": 5}) == 10
    assert contracts.shrinkage_of([first_only, weighted], {}) == 1.5
    world = spark.createDataFrame([(0, 0, 0, 3.0, 1.0), (1, 0, 0, 9.0, 1.0), (1, 0, 1, 4.0, 1.0), (0, 0, 1, 2.0, 1.0)], "view_id long, y long, x long, v double, w double")
    found = {(r["y"], r["x"]): r["fused"] for r in blocks.fuse_with(world, ["y", "x"], weighted, first_only, block=8).collect()}
    assert found == {(0, 0): 3.0, (0, 1): 2.0}
