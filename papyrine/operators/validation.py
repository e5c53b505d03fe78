"""Counts of violations of the data contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(nodes: DataFrame, assign: DataFrame, citations: DataFrame) -> DataFrame:
    """``(rule, violations)``."""
    one = lambda rule, df: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    last = nodes.filter("not is_ghost").agg(F.max("node_id").alias("last"))  # one row
    per_node = nodes.agg(
        F.count_if(F.col("is_ghost") & F.col("base_pos").isNotNull()).alias("ghost with position"),
        F.count_if(~F.col("is_ghost") & F.col("base_pos").isNull()).alias("node without usable position"),
        F.count_if(F.col("t").isNull() | ~F.col("t").between(0, 1)).alias("t outside 0 to 1"),
    )
    rows = per_node.unpivot([], per_node.columns, "rule", "violations")
    others = [
        one("ghost before the last node", nodes.filter("is_ghost").crossJoin(F.broadcast(last)).filter("node_id < last")),
        one("assignment of an unknown node", assign.join(nodes, "node_id", "left_anti")),
        one("cluster below -1", assign.filter("node_cluster < -1")),
        one("self-citation", citations.filter("citing_id = cited_id")),
    ]
    return reduce(DataFrame.unionByName, others, rows)


def vector_violations(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """``(missing, wrong_length, not_finite)`` of a vector column."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.agg(F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != dims).alias("wrong_length"), F.count_if(bad).alias("not_finite"))


def layout_violations(positions: DataFrame) -> DataFrame:
    """``(repeated, not_finite)`` of places ``(node_id, x, y, z)``."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return positions.agg((F.count("*") - F.countDistinct("node_id")).alias("repeated"), F.count_if(bad("x") | bad("y") | bad("z")).alias("not_finite"))


def tree_violations(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(roots, orphans, younger_parents, homeless)`` of a condensed tree and its leaves; a sound one has 1, 0, 0, 0."""
    up = tree.select(F.col("cluster").alias("parent"), F.col("birth").alias("parent_birth"))
    j = tree.filter("parent >= 0").join(up, "parent", "left")
    below = j.agg(F.count_if(F.col("parent_birth").isNull()).alias("orphans"), F.count_if(F.col("parent_birth") > F.col("birth")).alias("younger_parents"))
    homes = leaves.join(tree.select(F.col("cluster").alias("home")), "home", "left_anti").agg(F.count("*").alias("homeless"))
    return tree.agg(F.count_if(F.col("parent") < 0).alias("roots")).crossJoin(below).crossJoin(homes)  # one row each


def assignment_violations(assign: DataFrame) -> DataFrame:
    """``(level_uid, repeated, gaps)``: nodes assigned twice at a level, and numbers of clusters below the largest that no node has."""
    gaps = F.max("node_cluster") + 1 - F.countDistinct(F.when(F.col("node_cluster") >= 0, F.col("node_cluster")))
    return assign.groupBy("level_uid").agg((F.count("*") - F.countDistinct("node_id")).alias("repeated"), F.greatest(gaps, F.lit(0)).alias("gaps"))
