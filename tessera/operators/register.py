"""Pairwise registration of overlapping views: a function of two images (or two point sets) a pair and frame.

A method is any function ``f(fixed, moving, **options) -> {"affine_matrix", "quality"}``; the affine maps fixed to moving
pixels. Pixels are cropped to the overlap before they reach Python, and a pair and frame is one group.
"""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels

GEOMETRY = {"fixed_origin", "moving_origin", "fixed_spacing", "moving_spacing", "initial_affine"}
FIELDS = ["src", "dst", "t", "transform", "quality", "bbox_lower", "bbox_upper"]


def phase_correlation(fixed: np.ndarray, moving: np.ndarray, **options) -> dict:
    t, quality = kernels.phase_correlation(fixed, moving, **options)
    out = np.eye(fixed.ndim + 1)
    out[:-1, -1] = t
    return {"affine_matrix": out, "quality": quality}


def space_of(method) -> str:
    """The space that a method works in, from its arguments: points, physical or pixel; ValueError for half of a set."""
    names = set(inspect.signature(method).parameters)
    points, geometry = names & {"fixed_points", "moving_points"}, names & GEOMETRY
    if len(points) == 1:
        raise ValueError("a method takes both point sets or none")
    if points:
        return "points"
    if len(names & {"fixed", "moving"}) != 2:
        raise ValueError("a method takes both images")
    if geometry and geometry != GEOMETRY:
        raise ValueError(f"a method takes all of {sorted(GEOMETRY)} or none")
    return "physical" if geometry else "pixel"


def dispatched(method, fixed: np.ndarray, moving: np.ndarray, **options) -> dict:
    """The method's result; identity and unknown quality where an image is constant or empty."""
    for image in (fixed, moving):
        known = image[~np.isnan(image)]
        if not len(known) or known.max() == known.min():
            return {"affine_matrix": np.eye(fixed.ndim + 1), "quality": float("nan")}
    return method(fixed, moving, **options)


def register_pairs(edges: DataFrame, world: DataFrame, dims: list[str], method=phase_correlation, value: str = "v", **options) -> DataFrame:
    """(src, dst, t, transform, quality, bbox_lower, bbox_upper) of each edge and frame, the lower id fixed.

    edges: (src, dst, bbox_lower, bbox_upper, overlap) in whole world pixels. world: (view_id, t, <dims>, value). Each side's
    pixels meet the edge by an equi-join and a range filter, and both sides become one group of plain numeric columns.
    """
    n, space_ = len(dims), space_of(method)
    if space_ == "points":
        raise ValueError("register point sets with the markers module")
    inside = [F.col(d).between(F.get("bbox_lower", F.lit(i)), F.get("bbox_upper", F.lit(i))) for i, d in enumerate(dims)]
    test = inside[0]
    for more in inside[1:]:
        test = test & more

    def side(name: str, k: int) -> DataFrame:
        met = edges.select("src", "dst", "bbox_lower", "bbox_upper").join(world.withColumnRenamed("view_id", name), name).where(test)
        limits = [F.get(c, F.lit(i)).cast("long").alias(f"_{c}_{i}") for c in ("bbox_lower", "bbox_upper") for i in range(n)]
        return met.select("src", "dst", "t", F.lit(k).alias("_side"), *(F.col(d).cast("long").alias(f"_at_{i}") for i, d in enumerate(dims)), F.col(value).cast("double").alias("_v"), *limits)

    def pair(key: tuple, part: pa.Table) -> pa.Table:
        lo = np.array([part[f"_bbox_lower_{i}"][0].as_py() for i in range(n)])
        hi = np.array([part[f"_bbox_upper_{i}"][0].as_py() for i in range(n)])
        images = np.full((2, *(hi - lo + 1)), np.nan)
        at = tuple(part[f"_at_{i}"].to_numpy() - lo[i] for i in range(n))
        images[(part["_side"].to_numpy(), *at)] = part["_v"].to_numpy()
        given = options
        if space_ == "physical":
            given = options | {"fixed_origin": lo, "moving_origin": lo, "fixed_spacing": np.ones(n), "moving_spacing": np.ones(n), "initial_affine": np.eye(n + 1)}
        found = dispatched(method, images[0], images[1], **given)
        # About the overlap's corner, in world pixels.
        m, move = np.asarray(found["affine_matrix"], dtype=float), np.eye(n + 1)
        move[:n, n] = lo
        m = move @ m @ np.linalg.inv(move)
        names = [k.as_py() for k in key]
        lists = [[x.ravel().astype(float).tolist()] for x in (m, lo, hi)]
        return pa.table([pa.array([names[0]], pa.int64()), pa.array([names[1]], pa.int64()), pa.array([names[2]], pa.int32()), pa.array(lists[0], pa.list_(pa.float64())), pa.array([float(found["quality"])], pa.float64()), *(pa.array(x, pa.list_(pa.float64())) for x in lists[1:])], FIELDS)

    # A number of partitions, since by their few bytes the groups would be merged into few tasks, however long each takes.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = side("src", 0).unionByName(side("dst", 1)).repartition(tasks, "src", "dst", "t")
    return both.groupBy("src", "dst", "t").applyInArrow(pair, "src long, dst long, t int, transform array<double>, quality double, bbox_lower array<double>, bbox_upper array<double>")


def binning(shape: dict[str, int], spacing: dict[str, float], most_pixels: int = 400**3) -> dict[str, int]:
    """Smallest binning that leaves fewer pixels than ``most_pixels``: z alone while it is finest, else y and x together."""
    by = dict.fromkeys(shape, 1)
    while np.prod([s / by[d] for d, s in shape.items()]) >= most_pixels:
        now = {d: spacing[d] * by[d] for d in shape}
        if "z" in shape and now["z"] < min(now["y"], now["x"]):
            by["z"] *= 2
        else:
            by["y"] *= 2
            by["x"] *= 2
    return by


def external(name: str, module: str):
    """A method of a library that may be absent; calling it then raises ImportError."""

    def method(fixed: np.ndarray, moving: np.ndarray, **options) -> dict:
        import importlib

        return importlib.import_module(module).register(fixed, moving, **options)

    method.__name__ = name
    return method


registration_ants = external("registration_ants", "ants")
registration_elastix = external("registration_elastix", "itk")
