"""Connected components of an edge table, distributed: local union-find, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import saved

#: Edges (16 bytes each) up to which one task forms all components; more are formed by rounds of stars.
LOCAL_EDGES = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of this partition's edges; at most one edge for each node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
    nodes = [x for x in up if root(x) != x]
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_pydict({"u": np.array(part, np.int64), "v": np.array([root(x) for x in part], np.int64)})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node that an edge (a, b) joins to another; root is the smallest node of its component.

    Up to ``local_edges`` edges, after each partition has contracted its own, are a bounded task. Beyond, rounds go on until nothing changes; their number grows with the logarithm of a component's diameter. Stars are formed from minima and joins,
    so that a node with very many neighbours is never gathered; each round is a table in the shared folder.
    """
    pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    now = saved(pairs.mapInArrow(_contracted, "u long, v long"), "edges")
    seen, few = None, now.count() <= local_edges
    if few:
        now = saved(now.coalesce(1).mapInArrow(_contracted, "u long, v long"), "edges")
    while not few:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large.mapInArrow(_contracted, "u long, v long"), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = down.join(low, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = saved(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state[0] == state[2] and (state[0] == 0 or now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()):
            break
        if seen == (state[0], state[1]):
            break
        seen = (state[0], state[1])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
