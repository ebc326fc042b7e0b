"""Joins with a table of one row for each key, when one key may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more rows than this, or than a 100,000th of all rows, are joined by broadcast: at most 100,000 keys are.
HOT_ROWS = 10_000
HOT_KEYS = 100_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys`` (no nulls), which has the number of each key's rows in its column ``count`` (dropped); ``total`` is the number of all rows.

    The rows of hot keys stay where they are; all others are dealt out by key.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = table.where(F.col(count) > limit).drop(count), table.where(F.col(count) <= limit).drop(count)
    if not hot.limit(1).count():
        return rows.join(cold, keys)
    known = hot.select(*keys)
    rest = rows.join(F.broadcast(known), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
