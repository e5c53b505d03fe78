"""Joins on keys of which some hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHARE = 1000


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """``(key)`` of ``(key, n)``: keys with over a thousandth of all rows, hence under a thousand of them."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).filter(F.col("n") * _SHARE > F.col("total")).select(key)


def join_hot(rows: DataFrame, other: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined with ``other``, which holds a key once; ``counts``: (key, n) of ``rows``.

    Rows of hot keys stay where they are and meet the broadcast rows of ``other`` (under a thousand, see ``hot_keys``); the rest is shuffled.
    """
    hot = F.broadcast(hot_keys(counts, key))
    few = rows.join(F.broadcast(other.join(hot, key, "left_semi")), key)
    return few.unionByName(rows.join(hot, key, "left_anti").join(other, key))
