"""Taking rows out of a table by a list of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import saved

#: Keys (16 bytes each) that are broadcast at most; a longer list is joined by a shuffle.
MOST_BROADCAST = 500_000


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores after it if a column of that name is there (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(rows: DataFrame, keys: DataFrame, on: dict) -> DataFrame:
    """``rows`` without those whose expressions equal the columns of a row of ``keys``; nulls are equal to nulls.

    on: {column of keys: expression over rows}. The list is written once and counted; while it is short the rows are
    filtered where they are, so that their texts are not shuffled.
    """
    gone_as = {k: fresh(rows.columns, f"_gone_{k}") for k in on}
    key_as = {k: fresh([*rows.columns, *gone_as.values()], f"_key_{k}") for k in on}
    gone = saved(keys.select(*(F.col(k).alias(gone_as[k]) for k in on)).distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    wide = rows.withColumns({key_as[k]: e for k, e in on.items()})
    same = reduce(lambda a, b: a & b, (F.col(key_as[k]).eqNullSafe(F.col(gone_as[k])) for k in on))
    return wide.join(gone, same, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns))
