"""Every registered query of the tile engine against its SQL on DuckDB."""

from __future__ import annotations

import pytest

from tessera import queries as tile
from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(tile.QUERIES))
def test_query(spark, duck, name):
    found = tile.QUERIES[name](spark, SMALL).toPandas()
    if name in tile.ORACLES:
        same(found, duck.execute(tile.ORACLES[name]).df())
    else:
        assert len(found) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark):
    one = tile.fuse_weighted_average(spark, SMALL).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        same(one, tile.fuse_weighted_average(spark, SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overlap_is_no_nested_loop(spark):
    text = tile.view_overlap(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
