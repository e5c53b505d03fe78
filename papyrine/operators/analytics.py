"""Aggregations over clusters and links: centroids, degrees, flows, bridges, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(pos: DataFrame, assign: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., n, cx, cy, cz, spread)``: mean position and root mean square distance from it, noise left out."""
    j = assign.filter("node_cluster >= 0").join(pos, "node_id")
    return j.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, in_deg)`` for all nodes, 0 where nothing cites them."""
    deg = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_deg"))
    return nodes.select("node_id").join(deg, "node_id", "left").select("node_id", F.coalesce("in_deg", F.lit(0)).alias("in_deg"))


def flow(assign: DataFrame, edges: DataFrame) -> DataFrame:
    """``(level_uid, a, b, links)``: links between clusters of a level; an end in noise or without cluster drops the link."""
    a = assign.filter("node_cluster >= 0").select("level_uid", F.col("node_id").alias("src"), F.col("node_cluster").alias("a"))
    b = assign.filter("node_cluster >= 0").select("level_uid", F.col("node_id").alias("dst"), F.col("node_cluster").alias("b"))
    return edges.join(a, "src").join(b, ["dst", "level_uid"]).groupBy("level_uid", "a", "b").agg(F.count("*").alias("links"))


def flow_degrees(matrix: DataFrame) -> DataFrame:
    """``(level_uid, node_cluster, out_deg, in_deg, intra)`` of a flow matrix."""
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("node_cluster"), F.lit(c == "a").alias("outgoing")) for c in "ab"))).alias("e")
    m = matrix.select("level_uid", "links", (F.col("a") == F.col("b")).alias("own"), ends)
    add = lambda cond: F.sum(F.when(cond, F.col("links")).otherwise(0))
    return m.groupBy("level_uid", F.col("e.node_cluster").alias("node_cluster")).agg(
        add(~F.col("own") & F.col("e.outgoing")).alias("out_deg"), add(~F.col("own") & ~F.col("e.outgoing")).alias("in_deg"), add(F.col("own") & F.col("e.outgoing")).alias("intra")
    )


def out_fractions(matrix: DataFrame) -> DataFrame:
    total = F.sum("links").over(Window.partitionBy("level_uid", "a"))
    return matrix.select("level_uid", "a", "b", (F.col("links") / total).alias("fraction"))


def shares(fine: DataFrame, coarse: DataFrame, on: str = "node_id") -> DataFrame:
    """``(fine_level, coarse_level, fine, coarse, n, fraction, rank, span)`` for ``(fine_level, fine, node_id)`` and ``(coarse_level, coarse, node_id)``,
    largest share first, ties to the smaller coarse cluster; noise counts as a share of its own."""
    counts = fine.join(coarse, on).groupBy("fine_level", "coarse_level", "fine", "coarse").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fine_level", "coarse_level", "fine")
    return counts.select("*", (F.col("n") / F.sum("n").over(w)).alias("fraction"), F.row_number().over(w.orderBy(F.desc("n"), "coarse")).alias("rank"), F.count("*").over(w).alias("span"))


def bridges(share: DataFrame) -> DataFrame:
    """``(fine_level, coarse_level, fine, size, span, dominant, dominant_fraction, is_bridge, shares)`` of ``shares``."""
    text = F.concat_ws(":", F.col("coarse").cast("string"), F.concat(F.round(F.col("fraction") * 100).cast("int").cast("string"), F.lit("%")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda e: e["t"]), " ")
    first = F.col("rank") == 1
    return share.groupBy("fine_level", "coarse_level", "fine").agg(
        F.sum("n").alias("size"), F.max("span").alias("span"), F.max(F.when(first, F.col("coarse"))).alias("dominant"), F.max(F.when(first, F.col("fraction"))).alias("dominant_fraction"), (F.max("span") >= 2).alias("is_bridge"), listed.alias("shares")
    )


def level_pairs(assign: DataFrame, levels: DataFrame, adjacent: bool = False) -> DataFrame:
    """``shares`` of every level against every coarser one (or only the next)."""
    a = assign.join(levels.select("level_uid", "level_no"), "level_uid")
    fine = a.filter("node_cluster >= 0").select("node_id", F.col("level_no").alias("fine_level"), F.col("node_cluster").alias("fine"))
    coarse = a.select("node_id", F.col("level_no").alias("coarse_level"), F.col("node_cluster").alias("coarse"))
    counts = fine.join(coarse, "node_id").filter("coarse_level = fine_level - 1" if adjacent else "coarse_level < fine_level")
    counts = counts.groupBy("fine_level", "coarse_level", "fine", "coarse").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fine_level", "coarse_level", "fine")
    return counts.select("*", (F.col("n") / F.sum("n").over(w)).alias("fraction"), F.row_number().over(w.orderBy(F.desc("n"), "coarse")).alias("rank"), F.count("*").over(w).alias("span"))


def bridge_counts(assign: DataFrame, levels: DataFrame) -> DataFrame:
    """``(fine_level, coarse_level, bridges)``: fine clusters that reach two or more coarse ones; noise on either side doesn't count."""
    s = level_pairs(assign.filter("node_cluster >= 0"), levels)
    each = s.groupBy("fine_level", "coarse_level", "fine").agg(F.count("*").alias("span"))
    return each.groupBy("fine_level", "coarse_level").agg(F.count_if(F.col("span") >= 2).alias("bridges"))


def ten_bins(fraction: Column, bins: int = 10) -> Column:
    """Bin of a fraction of [0, 1], 1 falling into the last; unknown into the first."""
    return F.coalesce(F.least(F.floor(fraction * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted values, for an aggregation over bounded groups."""
    v = F.sort_array(F.collect_list(values))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def plateaus(steps: DataFrame) -> DataFrame:
    """``(count, size, width)`` for ``(size, count)``: for every count of at least 2 the middle size of its longest run of sizes (ties: the first)."""
    w = Window.orderBy("size")  # sizes of a sweep: a handful of rows
    runs = steps.withColumn("new", F.when(F.col("count") == F.lag("count").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    each = runs.groupBy("count", "run").agg(F.count("*").alias("width"), F.sort_array(F.collect_list("size")).alias("sizes"))
    best = each.filter("count >= 2").withColumn("r", F.row_number().over(Window.partitionBy("count").orderBy(F.desc("width"), "run"))).filter("r = 1")
    return best.select("count", F.get("sizes", F.floor((F.size("sizes") - 1) / 2).cast("int")).alias("size"), "width")


def average_rank(column: str, partition: list[str] | None = None) -> Column:
    """Rank with ties sharing their mean rank."""
    by = Window.partitionBy(*(partition or []))
    return F.rank().over(by.orderBy(column)) + (F.count("*").over(Window.partitionBy(*(partition or []), column)) - 1) / 2
