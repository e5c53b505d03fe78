"""The rows that count in tables with repeated, superseded and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(raw: DataFrame) -> DataFrame:
    """One row for each node, that with the latest ``ingested_at``; a position that isn't three finite numbers becomes null."""
    cols = ["paper_id", "t", "year", "is_ghost", "base_pos"]
    last = raw.groupBy("node_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r")).select("node_id", *(F.col(f"r.{c}").alias(c) for c in cols))
    fine = (F.size("base_pos") == 3) & F.forall("base_pos", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return last.withColumn("base_pos", F.when(fine, F.col("base_pos")))


def positions(raw: DataFrame) -> DataFrame:
    """``(node_id, x, y, z)`` of the nodes with a usable position."""
    n = nodes(raw).filter("base_pos is not null")
    return n.select("node_id", *(F.get("base_pos", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def assignments(raw: DataFrame) -> DataFrame:
    """``(level_uid, node_id, node_cluster)``: of the rows with a cluster the latest assigned."""
    rows = raw.filter("node_cluster is not null")
    last = F.max(F.struct("assigned_at", "arrived_at", "node_cluster"))["node_cluster"]
    return rows.groupBy("level_uid", "node_id").agg(last.alias("node_cluster"))


def edges(raw: DataFrame) -> DataFrame:
    """``(citing_id, cited_id)``: distinct citations between two different papers."""
    return raw.filter("citing_id is not null and cited_id is not null and citing_id <> cited_id").select("citing_id", "cited_id").distinct()


def node_edges(raw_edges: DataFrame, node: DataFrame) -> DataFrame:
    """``(src, dst)``: citations between known nodes, by ``node_id``."""
    a = node.select(F.col("paper_id").alias("citing_id"), F.col("node_id").alias("src"))
    b = node.select(F.col("paper_id").alias("cited_id"), F.col("node_id").alias("dst"))
    return edges(raw_edges).join(a, "citing_id").join(b, "cited_id").select("src", "dst")
