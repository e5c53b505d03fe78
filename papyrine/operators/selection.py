"""Selecting nodes by scores, and keeping scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_scores(scores: DataFrame, changes: DataFrame) -> DataFrame:
    """``(level_uid, node_cluster, score)`` after ``changes``; a null score clears."""
    new = changes.select("level_uid", "node_cluster", F.col("score").alias("new"), F.lit(True).alias("hit"))
    j = scores.join(new, ["level_uid", "node_cluster"], "full")
    return j.select("level_uid", "node_cluster", F.when(F.col("hit"), F.col("new")).otherwise(F.col("score")).alias("score")).filter("score is not null")


def select_nodes(assign: DataFrame, scores: DataFrame, level_uid: str, min_score: int | None = None, cluster: int | None = None) -> DataFrame:
    """``(node_id, node_cluster)`` of one cluster, or of the clusters of a level with at least a score."""
    level = assign.filter(F.col("level_uid") == level_uid)
    if cluster is not None:
        return level.filter(F.col("node_cluster") == cluster).select("node_id", "node_cluster")
    good = scores.filter((F.col("level_uid") == level_uid) & (F.col("score") >= (min_score or 1))).select("node_cluster")
    return level.join(good, "node_cluster", "left_semi").select("node_id", "node_cluster")


def add_first_wins(cart: DataFrame, items: DataFrame, key: str = "paper_id") -> DataFrame:
    """The cart with those items whose key it doesn't hold yet; of items with one key the first row by ``source`` stays."""
    first = items.groupBy(key).agg(F.min(F.struct(*[c for c in items.columns if c != key])).alias("r")).select(key, "r.*")
    return cart.unionByName(first.join(cart.select(key), key, "left_anti"))


def matches_text(columns: list[str], query: str):
    """Whether any of the columns contains the text, whatever the case."""
    return F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), lambda c: F.contains(F.lower(c), F.lit(query.lower())))


def is_selected(level_uid: str | None = None, cluster: int | None = None, origin: int | None = None, node: int | None = None):
    """The predicate of a selection: a cluster of a level, an origin, or a node."""
    if cluster is not None:
        return (F.col("level_uid") == level_uid) & (F.col("node_cluster") == cluster)
    if origin is not None:
        return F.col("origin_id") == origin
    return F.col("node_id") == node if node is not None else F.lit(False)
