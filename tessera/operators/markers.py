"""Registration of point sets: neighbourhood descriptors, ratio-tested matches, RANSAC, iterated closest points."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nearest import nearest
from tessera.operators.resolve import fit


def neighbours(points: DataFrame, k: int, position: list[str], on: str = "view_id", point: str = "point_id") -> DataFrame:
    """(view_id, point_id, other, rank, d2): the k nearest points in the same view, exactly; ties by id. A view a task; points
    without a position go."""
    a = points.select(on, point, *(F.col(p).cast("double").alias(p) for p in position)).dropna()
    kinds = dict(a.dtypes)

    def find(key: tuple, part: pa.Table) -> pa.Table:
        ids, at = np.asarray(part[point]), np.stack([np.asarray(part[p]) for p in position], axis=1)
        d2, near = nearest(at, ids, at, k + 1)
        # A point is not its own neighbour; others at the same place with smaller ids may stand before it, or all in its stead.
        keep = (near >= 0) & (ids[near] != ids[:, None])
        rank = np.cumsum(keep, axis=1)
        row, column = np.nonzero(keep & (rank <= k))
        out = [pa.array([key[0].as_py()] * len(row), part.schema.field(on).type), ids[row], ids[near[row, column]], rank[row, column].astype(np.int32), d2[row, column]]
        return pa.table(out, names=[on, point, "other", "rank", "d2"])

    return a.groupBy(on).applyInArrow(find, f"`{on}` {kinds[on]}, `{point}` {kinds[point]}, other {kinds[point]}, rank int, d2 double")


def descriptors(points: DataFrame, k: int, redundancy: int, position: list[str], on: str = "view_id", point: str = "point_id") -> DataFrame:
    """(view_id, point_id, combo, descriptor): for every k of a point's k + redundancy neighbours, the sorted distances between
    all of the point and them."""
    near = neighbours(points, k + redundancy, position, on, point)
    where = points.select(on, F.col(point).alias("other"), F.array(*(F.col(p).cast("double") for p in position)).alias("q"))
    own = points.select(on, point, F.array(*(F.col(p).cast("double") for p in position)).alias("p"))
    sets = near.join(where, [on, "other"]).groupBy(on, point).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("near"))
    sets = sets.where(F.size("near") >= k + redundancy).join(own, [on, point])
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = []
    for c, some in enumerate(combinations(range(k + redundancy), k)):
        spots = [F.col("p"), *(F.get("near", F.lit(i)) for i in some)]
        rows.append(F.struct(F.lit(c).alias("combo"), F.array_sort(F.array(*(apart(a, b) for a, b in combinations(spots, 2)))).alias("descriptor")))
    return sets.select(on, point, F.explode(F.array(*rows)).alias("r")).select(on, point, "r.*")


def matches(fixed: DataFrame, moving: DataFrame, ratio: float, limit: float, point: str = "point_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., fixed, moving, distance): nearest descriptors within ``limit`` that are ``ratio`` times nearer than the nearest of any
    other moving point; the smallest distance of each pair of points.

    A group of ``by`` is a task. Of a descriptor's nearest ones, one more than a point has, two are of different points.
    """
    keys = list(by) or ["_all"]
    side = lambda df, end: df.withColumn("_all", F.lit(0)).select(*keys, F.col(point).alias(end), F.col("descriptor").cast("array<double>").alias("d"))
    a, b = side(fixed, "fixed"), side(moving, "moving")
    b = b.select(*(F.col(c).alias(f"{c}2") for c in b.columns)).toDF(*b.columns)  # the sides may share columns of one table
    kinds = dict(a.dtypes) | dict(b.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in keys] + [f"fixed {kinds['fixed']}", f"moving {kinds['moving']}", "distance double"]

    def known(part: pa.Table, end: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(part[end])
        at = part["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        whole = ~np.isnan(at).any(axis=1)
        return ids[whole], at[whole]

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pd.DataFrame({"fixed": [], "moving": [], "distance": []})
        if len(left) and len(right):
            (own, p), (others, q) = known(left, "fixed"), known(right, "moving")
            if len(own) and len(others):
                most = int(np.unique(others, return_counts=True)[1].max())
                d2, near = nearest(q, others, p, most + 1, limit * max(ratio, 1.0) * (1 + 1e-9))
                d, who = np.sqrt(d2), others[near]
                second = np.where((near >= 0) & (who != who[:, :1]), d, np.inf).min(axis=1)
                good = (near[:, 0] >= 0) & (d[:, 0] <= limit) & ((d[:, 0] * ratio < second) | (d[:, 0] == 0) & (second > 0))
                rows = pd.DataFrame({"fixed": own[good], "moving": who[good, 0], "distance": d[good, 0]}).groupby(["fixed", "moving"], as_index=False)["distance"].min()
        ends = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.table([*ends, pa.array(rows["fixed"], left.schema.field("fixed").type), pa.array(rows["moving"], right.schema.field("moving").type), pa.array(rows["distance"], pa.float64())], names=[*keys, "fixed", "moving", "distance"])

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(find, ", ".join(fields)).select(*by, "fixed", "moving", "distance")


def least_matches(kind: str, n: int) -> int:
    return {"translation": 1, "rigid": n, "similarity": n, "affine": n + 1}[kind]


def _apply(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:-1, :-1].T + m[:-1, -1]


def ransac(fixed: np.ndarray, moving: np.ndarray, kind: str, most_error: float, least_ratio: float = 0.1, iterations: int = 1000, inlier_factor: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float] | None:
    """(affine, quality) of the model with the best share of inliers and their closeness; all samples if they are few, else
    seeded ones; refitted on its inliers. None where no model has enough."""
    n, k = fixed.shape[1], least_matches(kind, fixed.shape[1])
    if len(fixed) < k:
        return None
    r = np.random.default_rng(seed)
    every = comb(len(fixed), k) <= iterations
    samples = combinations(range(len(fixed)), k) if every else (r.choice(len(fixed), k, replace=False) for _ in range(iterations))
    best = None
    for some in samples:
        some = list(some)
        try:
            m = fit(kind, fixed[some], moving[some])
        except (ValueError, np.linalg.LinAlgError):
            continue
        error = np.linalg.norm(_apply(m, fixed) - moving, axis=1)
        ok = error <= most_error
        if ok.sum() < max(k, round(k * inlier_factor)) or ok.mean() < least_ratio:
            continue
        mean = error[ok].mean()
        score = (ok.mean() * (1 - mean / most_error), int(ok.sum()), -mean)
        if best is None or score > best[0]:
            best = (score, ok)
    if best is None:
        return None
    m = fit(kind, fixed[best[1]], moving[best[1]])
    return m, float(best[0][0])


def closest_points(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray, kind: str, most_error: float, iterations: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """The affine refitted on nearest neighbours within an error until it settles."""
    m = start
    for _ in range(iterations):
        at = _apply(m, fixed)
        d = np.linalg.norm(at[:, None] - moving[None], axis=2)
        near = d.argmin(axis=1)
        ok = d[np.arange(len(at)), near] <= most_error
        if ok.sum() < least_matches(kind, fixed.shape[1]):
            return m
        new = fit(kind, fixed[ok], moving[near[ok]])
        if np.linalg.norm(new - m) <= tolerance:
            return new
        m = new
    return m


def register_points(edges: DataFrame, points: DataFrame, pairs: DataFrame, position: list[str], kind: str = "rigid", most_error: float = 1.0, fail_on_error: bool = False, icp: bool = False, seed: int = 0) -> DataFrame:
    """(src, dst, transform, quality) from candidate pairs (src, dst, fixed, moving) of points; identity and unknown quality
    where no model is found, or ValueError with ``fail_on_error``."""
    n = len(position)
    a = points.select(F.col("view_id").alias("src"), F.col("point_id").alias("fixed"), *(F.col(p).alias(f"f{i}") for i, p in enumerate(position)))
    b = points.select(F.col("view_id").alias("dst"), F.col("point_id").alias("moving"), *(F.col(p).alias(f"m{i}") for i, p in enumerate(position)))
    rows = edges.select("src", "dst").distinct().join(pairs, ["src", "dst"]).join(a, ["src", "fixed"]).join(b, ["dst", "moving"])

    def pair(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fixed", "moving"])
        p, q = part[[f"f{i}" for i in range(n)]].to_numpy(dtype=float), part[[f"m{i}" for i in range(n)]].to_numpy(dtype=float)
        found = ransac(p, q, kind, most_error, seed=seed)
        if found is None and fail_on_error:
            raise ValueError(f"no transform for views {key}")
        m, quality = found or (np.eye(n + 1), float("nan"))
        if found and icp:
            m = closest_points(p, q, m, kind, most_error)
        return pd.DataFrame([{"src": key[0], "dst": key[1], "transform": m.ravel().tolist(), "quality": quality}])

    return rows.groupBy("src", "dst").applyInPandas(pair, "src long, dst long, transform array<double>, quality double")
