"""One session for all tests."""

from __future__ import annotations

import numbers
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def same(left, right) -> None:
    """Whether two pandas tables hold the same rows, to 1e-6, in any order."""
    import pandas as pd

    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{float(v) + 0.0:.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    rows = [sorted(tuple(text(v) for v in r) for r in d[columns].itertuples(index=False)) for d in (left, right)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
