"""From pairwise transforms to one transform a view: paths, least squares, and relaxation of virtual beads.

An edge's affine maps its source (the lower id) to its target. Components are found distributed; each is solved by a
numpy function in one task, as its unknowns are a few numbers a view.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import affine
from tessera.functions.laplacian import sparse_differences
from tessera.operators.graph import checkpointed, components, shortest_paths

PARAMS = "view_id long, t int, affine array<double>"
RESOLVERS: dict = {}
#: Unknowns up to which normal equations are solved as a dense matrix.
DENSE = 500


def register_resolver(name: str, resolver) -> None:
    """Make ``resolver(edges, nodes, n, reference, **options) -> {view: matrix}`` available by name."""
    if not callable(resolver):
        raise TypeError(f"{resolver!r} is not callable")
    RESOLVERS[name] = resolver


def virtual_beads(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, corner, p, q): corners of an edge's box in its source, and where its transform puts them."""
    spots = [F.array(*(F.get("bbox_upper" if far else "bbox_lower", F.lit(d)).cast("double") for d, far in enumerate(s))) for s in product((0, 1), repeat=n)]
    rows = edges.select("src", "dst", "transform", F.posexplode(F.array(*spots)).alias("corner", "p"))
    return rows.select("src", "dst", "corner", "p", affine.apply(F.col("transform"), F.col("p"), n).alias("q"))


def edge_residuals(beads: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """(src, dst, rms): root mean square distance of an edge's beads under the views' transforms, pruned edges included."""
    a = params.select(F.col("view_id").alias("src"), F.col("affine").alias("au"))
    b = params.select(F.col("view_id").alias("dst"), F.col("affine").alias("av"))
    both = beads.join(a, "src").join(b, "dst")
    apart = F.zip_with(affine.apply(F.col("au"), F.col("p"), n), affine.apply(F.col("av"), F.col("q"), n), lambda x, y: (x - y) * (x - y))
    return both.withColumn("d2", F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).groupBy("src", "dst").agg(F.sqrt(F.avg("d2")).alias("rms"))


def _reference(edges: pd.DataFrame, nodes: list[int]) -> int:
    """The lower of two views; otherwise that with the largest sum of qualities."""
    if len(nodes) == 2:
        return min(nodes)
    total = dict.fromkeys(nodes, 0.0)
    for a, b, q in zip(edges["src"], edges["dst"], edges["quality"].fillna(0.0), strict=True):
        total[a] += q
        total[b] += q
    return max(nodes, key=lambda v: (total[v], -v))


def by_paths(edges: pd.DataFrame, nodes: list[int], n: int, reference: int | None = None) -> dict[int, np.ndarray]:
    """Transforms along shortest paths of weight 1 / (quality - least quality + 0.5), concatenated and inverted."""
    ref = reference if reference in nodes else _reference(edges, nodes)
    least = edges["quality"].min()
    weight = [(int(a), int(b), 1 / (q - least + 0.5)) for a, b, q in zip(edges["src"], edges["dst"], edges["quality"], strict=True)]
    step = {}
    for a, b, m in zip(edges["src"], edges["dst"], edges["transform"], strict=True):
        m = np.array(m).reshape(n + 1, n + 1)
        step[a, b], step[b, a] = m, np.linalg.inv(m)
    before, out = shortest_paths(weight, ref), {ref: np.eye(n + 1)}
    for v in nodes:
        path, u = [], v
        while u is not None and u not in out:
            path.append(u)
            u = before.get(u)
        for u in reversed(path):
            p = before[u]
            # From the reference outwards; inverse of the concatenation, as coordinates go from the view to the reference.
            out[u] = out[p] @ np.linalg.inv(step[p, u])
    return out


def rotation_of(linear: np.ndarray) -> tuple[np.ndarray, float]:
    """(nearest rotation, mean scale) of a linear map."""
    u, s, v = np.linalg.svd(linear)
    flip = np.eye(len(s))
    flip[-1, -1] = np.sign(np.linalg.det(u @ v))
    return u @ flip @ v, float(s.mean())


def _to_vector(r: np.ndarray) -> np.ndarray:
    if len(r) == 2:
        return np.array([np.arctan2(r[1, 0], r[0, 0])])
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return axis / 2 if angle < 1e-9 else axis * angle / (2 * np.sin(angle))


def _from_vector(v: np.ndarray) -> np.ndarray:
    if len(v) == 1:
        c, s = np.cos(v[0]), np.sin(v[0])
        return np.array([[c, -s], [s, c]])
    angle = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + (np.sin(angle) / angle if angle > 1e-12 else 1.0) * k + ((1 - np.cos(angle)) / angle**2 if angle > 1e-12 else 0.5) * k @ k


def _differences(pairs: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: int, ref: int) -> np.ndarray:
    """x with x_u - x_v = b for each pair (u, v) of nodes 0, 1, ... in the weighted least squares sense, 0 at the reference:
    normal equations, dense up to ``DENSE`` unknowns and sparse beyond."""
    out = np.zeros((nodes, b.shape[1]))
    free = np.flatnonzero(np.arange(nodes) != ref)
    if len(free) > DENSE:
        return sparse_differences(pairs, b, w, nodes, ref)
    m, y = np.zeros((nodes, nodes)), np.zeros((nodes, b.shape[1]))
    for x, other, sign in ((0, 1, 1.0), (1, 0, -1.0)):
        np.add.at(m, (pairs[:, x], pairs[:, x]), w)
        np.add.at(m, (pairs[:, x], pairs[:, other]), -w)
        np.add.at(y, pairs[:, x], sign * w[:, None] * b)
    if len(free):
        out[free] = np.linalg.lstsq(m[np.ix_(free, free)], y[free], rcond=None)[0]
    return out


def _spanning(pairs: list[list[int]], cost: np.ndarray) -> set[int]:
    """Edges of a spanning tree of least cost."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    keep = set()
    for k in np.argsort(cost, kind="stable"):
        a, b = root(pairs[k][0]), root(pairs[k][1])
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.add(int(k))
    return keep


def two_pass(edges: pd.DataFrame, nodes: list[int], n: int, reference: int | None = None, transform: str = "rigid", residual_threshold: float | None = None, mad_k: float = 2.0, weight: str = "quality_overlap") -> dict[int, np.ndarray]:
    """Weighted differences of rotations, then of translations; edges far off go, but for a spanning tree; solved again."""
    if transform not in ("translation", "rigid"):
        raise ValueError(f"{transform} is not a kind of transform for two passes")
    ref = reference if reference in nodes else _reference(edges, nodes)
    place = {v: k for k, v in enumerate(nodes)}
    pairs = np.array([(place[int(a)], place[int(b)]) for a, b in zip(edges["src"], edges["dst"], strict=True)], np.int64).reshape(-1, 2)
    matrices = np.stack([np.asarray(m, dtype=float) for m in edges["transform"]]).reshape(-1, n + 1, n + 1)
    part = {"quality_overlap": edges["quality"] * edges["overlap"], "quality": edges["quality"], "overlap": edges["overlap"]}.get(weight, edges["quality"] * 0 + 1.0)
    w = part.to_numpy(dtype=float)
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    middle = (np.stack(edges["bbox_lower"].tolist()).astype(float) + np.stack(edges["bbox_upper"].tolist())) / 2
    moved = (matrices @ np.concatenate([middle, np.ones((len(middle), 1))], axis=1)[..., None])[:, :n, 0]
    u, v = pairs.T
    use = np.arange(len(pairs))
    for last in (False, True):
        turns = np.broadcast_to(np.eye(n), (len(nodes), n, n))
        if transform == "rigid":
            # A_u = A_v M: the rotation of u is that of v after the edge's.
            seen = np.array([_to_vector(rotation_of(matrices[k, :n, :n])[0]) for k in use])
            turns = np.stack([_from_vector(x) for x in _differences(pairs[use], seen, w[use], len(nodes), place[ref])])
        # At the edge's middle c: R_u c + t_u = R_v (M c) + t_v.
        b = (turns[v] @ moved[..., None] - turns[u] @ middle[..., None])[..., 0]
        shift = _differences(pairs[use], b[use], w[use], len(nodes), place[ref])
        affines = np.broadcast_to(np.eye(n + 1), (len(nodes), n + 1, n + 1)).copy()
        affines[:, :n, :n], affines[:, :n, n] = turns, shift
        out = dict(zip(nodes, affines, strict=True))
        off = np.linalg.norm(shift[u] - shift[v] - b, axis=1)
        if last or len(pairs) < 2:
            return out
        limit = residual_threshold if residual_threshold is not None else np.median(off) + mad_k * np.median(np.abs(off - np.median(off)))
        tree = np.zeros(len(pairs), bool)
        tree[list(_spanning(pairs.tolist(), off))] = True
        use = np.flatnonzero((off <= limit + 1e-12) | tree)
        if len(use) == len(pairs):
            return out
    return out


def fit(kind: str, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The transform of a kind (translation, rigid, similarity, affine) that maps src to dst with the least squares."""
    n = src.shape[1]
    out = np.eye(n + 1)
    a, b = src.mean(axis=0), dst.mean(axis=0)
    if kind in ("rigid", "similarity"):
        u, s, v = np.linalg.svd((dst - b).T @ (src - a))
        flip = np.ones(n)
        flip[-1] = np.sign(np.linalg.det(u @ v))
        r = u @ np.diag(flip) @ v
        scale = (s * flip).sum() / max(((src - a) ** 2).sum(), 1e-12) if kind == "similarity" else 1.0
        out[:n, :n] = scale * r
    elif kind == "affine":
        x = np.column_stack([src, np.ones(len(src))])
        if np.linalg.matrix_rank(x) < n + 1:
            raise ValueError("points lie in a plane")
        out[:n] = np.linalg.lstsq(x, dst, rcond=None)[0].T
        return out
    elif kind != "translation":
        raise ValueError(f"unknown kind of transform {kind}")
    out[:n, n] = b - out[:n, :n] @ a
    return out


def relaxed(edges: pd.DataFrame, nodes: list[int], n: int, reference: int | None = None, transform: str = "translation", max_iter: int = 500, rel_tol: float = 1e-4, abs_tol: float = 3.0) -> dict[int, np.ndarray]:
    """Views moved in turn, most neighbours first, onto the beads of their neighbours until residuals settle; while the worst
    residual exceeds ``abs_tol``, the edge with the largest (1 - quality)^2 * sqrt(residual) * log10(degree) whose loss
    disconnects nothing goes and all is done again."""
    ref = reference if reference in nodes else _reference(edges, nodes)
    beads = {}
    for a, b, m, lo, hi, q in zip(edges["src"], edges["dst"], edges["transform"], edges["bbox_lower"], edges["bbox_upper"], edges["quality"], strict=True):
        p = np.array([[hi[d] if f else lo[d] for d, f in enumerate(s)] + [1.0] for s in product((0, 1), repeat=n)])
        beads[int(a), int(b)] = (p, p @ np.array(m).reshape(n + 1, n + 1).T, float(q))
    place = {v: np.eye(n + 1) for v in nodes}
    while True:
        near = {v: [(e, e.index(v)) for e in beads if v in e] for v in nodes}
        turn = sorted(nodes, key=lambda v: (-len(near[v]), v))
        old = None
        for step in range(max_iter):
            for v in turn:
                if v != ref and near[v]:
                    own = np.concatenate([(beads[e][k] @ place[v].T)[:, :n] for e, k in near[v]])
                    other = np.concatenate([(beads[e][1 - k] @ place[e[1 - k]].T)[:, :n] for e, k in near[v]])
                    place[v] = fit(transform, own, other) @ place[v]
            off = {(a, b): np.linalg.norm((p @ place[a].T - q @ place[b].T)[:, :n], axis=1) for (a, b), (p, q, _) in beads.items()}
            worst = max((x.max() for x in off.values()), default=0.0)
            change = max((np.abs(off[e] - old[e]).max() for e in off), default=0.0) / worst if old and worst > 0 else 0.0
            if step > 5 and change < rel_tol:
                break
            old = off
        if len(beads) < 2 or worst < abs_tol:
            return place
        degree = {v: len(near[v]) for v in nodes}
        cost = {e: (1 - beads[e][2]) ** 2 * np.sqrt(off[e].max()) * np.log10(max(degree[e[0]], degree[e[1]])) for e in beads}
        gone = next((e for e in sorted(beads, key=lambda e: -cost[e]) if e[1] in shortest_paths([(a, b, 1.0) for a, b in beads if (a, b) != e], e[0])), None)
        if gone is None:
            return place
        del beads[gone]


for _name, _resolver in (("shortest_paths", by_paths), ("linear_two_pass", two_pass), ("global_optimization", relaxed)):
    register_resolver(_name, _resolver)


def resolve(edges: DataFrame, nodes: DataFrame, n: int, method: str = "global_optimization", reference: int | None = None, **options) -> DataFrame:
    """(view_id, t, affine) by the named method for each frame and component; views without edges get the identity.

    edges: (src, dst, t, transform, quality, overlap, bbox_lower, bbox_upper).
    """
    if method not in RESOLVERS:
        raise ValueError(f"unknown method {method}")
    resolver = RESOLVERS[method]
    edges = checkpointed(edges)  # registered once, not for the components, the solution and the frames each
    label = components(nodes, edges.select("src", "dst").distinct())
    own = edges.join(label.withColumnRenamed("view_id", "src"), "src")

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        t, views = key[0], sorted(set(part["src"]) | set(part["dst"]))
        part = part.sort_values(["src", "dst"]).reset_index(drop=True)
        found = resolver(part, views, n, reference, **options)
        return pd.DataFrame({"view_id": views, "t": [t] * len(views), "affine": [found.get(v, np.eye(n + 1)).ravel().tolist() for v in views]})

    solved = own.groupBy("t", "component").applyInPandas(solve, PARAMS)
    frames = sorted((r["t"] for r in edges.select("t").distinct().collect()), key=lambda t: (t is not None, t)) or [None]
    every = nodes.select("view_id", F.explode(F.array(*(F.lit(t).cast("int") for t in frames))).alias("t"))
    found = solved.select(F.col("view_id").alias("v"), F.col("t").alias("s"), "affine")
    return every.join(found, (F.col("view_id") == F.col("v")) & F.col("t").eqNullSafe(F.col("s")), "left").select("view_id", "t", F.coalesce("affine", affine.identity(n)).alias("affine"))


def translation_edges(edges: DataFrame, shift: list[Column], box: tuple[list[str], list[str]]) -> DataFrame:
    """Edges with whole columns of shifts and box corners as edges with arrays."""
    arrays = {"bbox_lower": F.array(*(F.col(c).cast("double") for c in box[0])), "bbox_upper": F.array(*(F.col(c).cast("double") for c in box[1]))}
    return edges.select("src", "dst", F.lit(0).alias("t"), affine.translation(shift).alias("transform"), "quality", F.col("overlap").cast("double").alias("overlap"), *(v.alias(k) for k, v in arrays.items()))
