"""Parts of a corpus: random and connected subsets, links within them, candidates for ghosts, links through removed papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.graph import hops


def random_subset(nodes: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """The ``size`` nodes with the smallest seeded hashes: the same whatever the partitioning."""
    return nodes.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(size)


def connected_subset(edges: DataFrame, start: DataFrame, size: int, most_hops: int = 6) -> DataFrame:
    """``(node_id, hops)``: the ``size`` nodes nearest to ``start`` (id) by steps, ties to the smaller id."""
    return hops(edges, start, most_hops).select(F.col("id").alias("node_id"), "hops").orderBy("hops", "node_id").limit(size)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among ``nodes`` (node_id)."""
    a, b = nodes.select(F.col("node_id").alias("src")), nodes.select(F.col("node_id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def ghost_candidates(pending: DataFrame, least: int = 2) -> DataFrame:
    """``(paper_id, degree)``: papers known only as ends of at least ``least`` distinct pending links (known_id, unknown_id)."""
    return pending.distinct().groupBy(F.col("unknown_id").alias("paper_id")).agg(F.count("*").alias("degree")).filter(F.col("degree") >= least)


def contracted_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Links between kept nodes, and links that join two kept nodes through one removed node (node_id)."""
    at_src, at_dst = removed.select(F.col("node_id").alias("src")), removed.select(F.col("node_id").alias("dst"))
    kept = edges.join(at_src, "src", "left_anti").join(at_dst, "dst", "left_anti").select("src", "dst")
    into = edges.join(at_dst, "dst", "left_semi").join(at_src, "src", "left_anti").select("src", F.col("dst").alias("mid"))
    out = edges.join(at_src, "src", "left_semi").join(at_dst, "dst", "left_anti").select(F.col("src").alias("mid"), "dst")
    return kept.unionByName(into.join(out, "mid").select("src", "dst")).filter("src <> dst").distinct()
