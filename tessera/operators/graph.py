"""Operators of the view graph: components, thresholds, references, pruning."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotEnoughOverlapError(ValueError):
    """No pair of views overlaps."""


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder of spark.checkpoint.dir; a folder of this machine only where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or "cluster" in sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(view_id, component): the smallest view reachable over edges (src, dst), by minima of neighbours and of labels' labels."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = checkpointed(both.union(both.select("v", "u")).distinct())
    label = nodes.select("view_id", F.col("view_id").alias("component"))
    while True:
        low = both.join(label.withColumnRenamed("view_id", "v"), "v").groupBy("u").agg(F.min("component").alias("low"))
        near = label.join(low, label["view_id"] == low["u"], "left").select("view_id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("old"))
        jump = near.select(F.col("view_id").alias("j"), F.col("component").alias("jc"))
        new = checkpointed(near.join(jump, near["component"] == jump["j"]).select("view_id", F.least("component", "jc").alias("component"), "old"))
        label = new.select("view_id", "component")
        if new.where("component <> old").isEmpty():
            break
    return label


def otsu_threshold(edges: DataFrame, weight: str = "overlap", bins: int = 256) -> float | None:
    """Otsu's threshold over a histogram of at most ``bins`` rows; None for no edges or a single value."""
    span = edges.agg(F.min(weight).alias("lo"), F.max(weight).alias("hi")).first()
    if span["lo"] is None or span["lo"] == span["hi"]:
        return None
    width = (span["hi"] - span["lo"]) / bins
    cell = F.least(F.floor((F.col(weight) - span["lo"]) / width), F.lit(bins - 1)).cast("int")
    rows = edges.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()
    centre = np.array([span["lo"] + (r["cell"] + 0.5) * width for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    below, mass = np.cumsum(n)[:-1], np.cumsum(n * centre)[:-1]
    above = n.sum() - below
    between = below * above * (mass / below - ((n * centre).sum() - mass) / above) ** 2
    return float(centre[np.argmax(between)])


def filter_edges(edges: DataFrame, weight: str = "overlap", threshold: float | None = None) -> DataFrame:
    """Edges of at least the threshold (Otsu's by default); an unknown (NaN) weight stays."""
    limit = threshold if threshold is not None else otsu_threshold(edges, weight)
    return edges if limit is None else edges.where(F.isnan(F.col(weight).cast("double")) | (F.col(weight) >= limit))


def axis_aligned(edges: DataFrame, centres: DataFrame, n: int, most_angle: float = 0.05) -> DataFrame:
    """Edges between views whose centres (view_id, centre) are apart along an axis, up to an angle."""
    a = centres.select(F.col("view_id").alias("src"), F.col("centre").alias("ca"))
    b = centres.select(F.col("view_id").alias("dst"), F.col("centre").alias("cb"))
    both = edges.join(a, "src").join(b, "dst").withColumn("d", F.zip_with("ca", "cb", lambda x, y: y - x))
    length = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x))
    near = F.exists("d", lambda x: F.acos(F.least(F.abs(x) / length, F.lit(1.0))) < most_angle)
    return both.where(near).select(*edges.columns)


def reference_view(edges: DataFrame, weight: str = "overlap") -> DataFrame:
    """(view_id, total): the view with the largest sum of incident weights; the smallest id of equals."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("view_id"), F.col(weight).alias("w"))
    return ends.groupBy("view_id").agg(F.sum("w").alias("total")).orderBy(F.desc("total"), "view_id").limit(1)


def shortest_paths(edges: list[tuple[int, int, float]], source: int) -> dict[int, int | None]:
    """Predecessor of each reachable node on a shortest path from ``source``; the smaller predecessor of equals."""
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    best, before, todo = {source: 0.0}, {source: None}, [(0.0, source)]
    done = set()
    while todo:
        d, u = heapq.heappop(todo)
        if u in done:
            continue
        done.add(u)
        for v, w in sorted(near[u]):
            if v not in done and d + w < best.get(v, np.inf) - 1e-12:
                best[v], before[v] = d + w, u
                heapq.heappush(todo, (d + w, v))
    return before


def _reference(edges: pd.DataFrame, weight: str) -> int:
    total = pd.concat([edges.groupby("src")[weight].sum(), edges.groupby("dst")[weight].sum()]).groupby(level=0).sum()
    return int(total.index[np.argmax(total.to_numpy())])


def prune_shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each component, the edges on shortest paths (weight 1 / (overlap + 1)) to its reference view. A task a component."""
    label = components(nodes, edges)
    own = edges.select("src", "dst", F.col("overlap").cast("double").alias("overlap")).join(label.withColumnRenamed("view_id", "src"), "src")

    def keep(key, part: pd.DataFrame) -> pd.DataFrame:
        before = shortest_paths([(a, b, 1 / (w + 1)) for a, b, w in zip(part["src"], part["dst"], part["overlap"], strict=True)], _reference(part, "overlap"))
        used = {(min(u, v), max(u, v)) for v, u in before.items() if u is not None}
        mask = [(min(a, b), max(a, b)) in used for a, b in zip(part["src"], part["dst"], strict=True)]
        return part[mask][["src", "dst", "overlap"]]

    return own.groupBy("component").applyInPandas(keep, "src long, dst long, overlap double")


def greedy_colors(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest free colour for each node, nodes of more neighbours first."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    color: dict[int, int] = {}
    for v in sorted(nodes, key=lambda v: (-len(near[v]), v)):
        taken = {color[u] for u in near[v] if u in color}
        color[v] = next(c for c in range(len(nodes) + 1) if c not in taken)
    return color


def edge_betweenness(nodes: list[int], edges: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Shares of shortest paths (by number of edges) through each edge, unweighted, over all pairs."""
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = dict.fromkeys(edges, 0.0)
    for s in nodes:
        order, paths, dist, before = [], {s: 1.0}, {s: 0}, defaultdict(list)
        layer = [s]
        while layer:
            following = []
            for u in layer:
                order.append(u)
                for v in near[u]:
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        following.append(v)
                    if dist[v] == dist[u] + 1:
                        paths[v] = paths.get(v, 0.0) + paths[u]
                        before[v].append(u)
            layer = following
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share = paths[u] / paths[v] * (1 + flow[v])
                flow[u] += share
                out[(u, v) if (u, v) in out else (v, u)] += share
    scale = max(len(nodes) * (len(nodes) - 1), 1)
    return {e: w / scale for e, w in out.items()}


def prune_alternating(edges: DataFrame, nodes: DataFrame, n_colors: int = 2) -> DataFrame:
    """(src, dst, overlap): edges left when the weakest, of growing overlap, have gone until ``n_colors`` colours suffice.

    An edge's strength is its overlap and, as a tie-break of at most half the least overlap, its betweenness; an edge that
    is the last of a view stays. A task a component; when thresholds run out the graph is left as it is.
    """
    label = components(nodes, edges)
    own = edges.select("src", "dst", F.col("overlap").cast("double").alias("overlap")).join(label.withColumnRenamed("view_id", "src"), "src")

    def keep(key, part: pd.DataFrame) -> pd.DataFrame:
        left = {(int(a), int(b)): float(w) for a, b, w in zip(part["src"], part["dst"], part["overlap"], strict=True)}
        ids = sorted({v for e in left for v in e})
        between = edge_betweenness(ids, sorted(left))
        lo, hi = min(between.values()), max(between.values())
        tie = {e: (between[e] - lo) / (hi - lo) * 0.5 * min(left.values()) if hi > lo else 0.0 for e in left}
        strength = {e: left[e] + tie[e] for e in left}
        for limit in sorted(set(strength.values())):
            if len(set(greedy_colors(ids, sorted(left)).values())) <= n_colors:
                break
            degree = defaultdict(int)
            for e in left:
                degree[e[0]] += 1
                degree[e[1]] += 1
            left = {e: w for e, w in left.items() if strength[e] > limit or min(degree[e[0]], degree[e[1]]) <= 1}
        return pd.DataFrame([(a, b, w) for (a, b), w in sorted(left.items())], columns=["src", "dst", "overlap"])

    return own.groupBy("component").applyInPandas(keep, "src long, dst long, overlap double")


def prune(edges: DataFrame, nodes: DataFrame, method: str | None, centres: DataFrame | None = None, n: int = 2, **options) -> DataFrame:
    """One of the pruning methods by name; NotEnoughOverlapError for a graph without edges, ValueError for another name."""
    if edges.isEmpty():
        raise NotEnoughOverlapError("no views overlap")
    ways = {
        None: lambda: edges,
        "alternating_pattern": lambda: prune_alternating(edges, nodes, **options),
        "shortest_paths_overlap_weighted": lambda: prune_shortest_paths(edges, nodes),
        "otsu_threshold_on_overlap": lambda: filter_edges(edges, **options),
        "keep_axis_aligned": lambda: axis_aligned(edges, centres, n, **options),
    }
    if method not in ways:
        raise ValueError(f"unknown pruning method {method}")
    return ways[method]()
