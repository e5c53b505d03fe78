"""Levels of detail of a condensed tree, in SQL on its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.analytics import plateaus


def first_child_births(tree: DataFrame) -> DataFrame:
    return tree.filter("parent >= 0").groupBy(F.col("parent").alias("cluster")).agg(F.min("birth").alias("end"))


def discover_layers(tree: DataFrame, leaves: DataFrame, cap: int = 5, least: int = 2) -> DataFrame:
    """``(count, level, persistence)``: the numbers of clusters alive over the widest ranges of log level; tree: (cluster, parent, birth), leaves: (level).

    Clusters are few against rows, but windows run over all of a tree's events: this is for one tree at a time.
    """
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), c)
    most = tree.agg(F.max(finite(F.col("birth"))).alias("a")).crossJoin(leaves.agg(F.max(finite(F.col("level"))).alias("b"))).select(F.greatest("a", "b").alias("most"))  # one row
    spans = tree.filter("parent >= 0").join(first_child_births(tree), "cluster", "left").crossJoin(F.broadcast(most)).select(F.col("birth").alias("lo"), F.least(F.coalesce("end", "most"), "most").alias("hi")).filter("hi > lo")
    events = spans.select(F.explode(F.array(F.struct(F.col("lo").alias("level"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("level"), F.lit(-1).alias("d")))).alias("e")).groupBy("e.level").agg(F.sum("e.d").alias("d"))
    w = Window.orderBy("level")
    seg = events.select(F.col("level").alias("lo"), F.lead("level").over(w).alias("hi"), F.sum("d").over(w).alias("count")).filter(f"hi is not null and count >= {least} and lo > 0")
    seg = seg.withColumn("width", F.log(F.col("hi") / F.col("lo"))).filter("width > 0")
    each = seg.groupBy("count").agg(F.sum("width").alias("persistence"), F.max(F.struct("width", F.sqrt(F.col("lo") * F.col("hi")).alias("level")))["level"].alias("level"))
    return each.orderBy(F.desc("persistence"), "count").limit(cap).select("count", "level", "persistence")


def ladder(candidates: DataFrame, picked: list[int], prefix: str = "ML") -> DataFrame:
    """``(uid, count, size)``: the candidates with the picked counts, coarse to fine; counts without candidate and repeats are passed over."""
    kept = candidates.filter(F.col("count").isin(sorted(set(picked))))
    number = F.row_number().over(Window.orderBy("count")) - 1
    return kept.select(F.concat(F.lit(f"{prefix}-L"), number.cast("string")).alias("uid"), "count", "size")


__all__ = ["discover_layers", "first_child_births", "ladder", "plateaus"]
