"""Joins whose known heavy keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaq.scratch import checkpointed

#: Rows of a key beyond which it is heavy; a table of n rows has at most n / HEAVY such keys.
HEAVY = 100_000


def heavy_keys(counts: DataFrame, keys: list[str], n: str, heavy: int = HEAVY) -> DataFrame | None:
    """The keys with more than ``heavy`` rows and their counts, or None where there are none."""
    found = checkpointed(counts.where(F.col(n) > heavy).select(*keys, F.col(n).alias("heavy_n")))
    return None if found.isEmpty() else found


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` unique in ``keys``.

    Rows of heavy keys stay where they are and get the table's few rows of these
    keys by broadcast; the list is short by the definition of heavy. NULL keys join nothing.
    """
    if heavy is None:
        return rows.join(table, keys)
    few = F.broadcast(heavy.select(*keys))
    hot = rows.join(few, keys, "left_semi").join(F.broadcast(table.join(few, keys, "left_semi")), keys)
    return rows.join(few, keys, "left_anti").join(table, keys).unionByName(hot)
