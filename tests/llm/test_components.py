"""Connected components, in one task and by rounds, against union-find."""

from __future__ import annotations

import random

import pytest

from tessera.llm.components import components


@pytest.mark.parametrize("local", [0, 10**6])
@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind, local):
    r = random.Random(1)
    edges = {
        "path": [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)],
        "star": [(50, i) for i in range(100) if i != 50],
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(-5, -9), (3, 3)],
        "none": [],
    }[kind]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    joined = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(3), local).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((x, root(x)) for x in joined)
