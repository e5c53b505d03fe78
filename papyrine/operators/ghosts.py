"""Nodes without a position: their nearest positioned neighbours, labels, and the pairs they connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.numbering import numbered
from papyrine.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def nearest_neighbour(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ghost, nearest, neighbours)``: of the positioned nodes linked to a ghost that nearest in time, ties to the smaller id.

    A ghost has no position, so nearness is measured on ``t``.
    """
    g = nodes.filter("is_ghost").select(F.col("node_id").alias("a"), F.col("t").alias("gt"))
    n = nodes.filter("base_pos is not null").select(F.col("node_id").alias("b"), F.col("t").alias("nt"))
    near = _both(edges).join(g, "a").join(n, "b")
    return near.groupBy(F.col("a").alias("ghost")).agg(F.min(F.struct(F.abs(F.col("gt") - F.col("nt")).alias("gap"), "b"))["b"].alias("nearest"), F.count("*").alias("neighbours"))


def inherit_labels(nodes: DataFrame, edges: DataFrame, labels: DataFrame, structural: int = -1, reserve: bool = False) -> DataFrame:
    """``(node_id, node_cluster)`` of the ghosts: the label of the nearest neighbour, ``structural`` without one; ``reserve``: a cluster of their own after the last one instead."""
    near = nearest_neighbour(nodes, edges).select(F.col("ghost").alias("node_id"), "nearest")
    of = labels.select(F.col("node_id").alias("nearest"), "node_cluster")
    out = nodes.filter("is_ghost").select("node_id").join(near, "node_id", "left").join(of, "nearest", "left")
    if reserve:
        after = labels.agg((F.coalesce(F.max("node_cluster"), F.lit(-1)) + 1).alias("after"))  # one row
        return out.crossJoin(F.broadcast(after)).select("node_id", F.coalesce("node_cluster", "after").alias("node_cluster"))
    return out.select("node_id", F.coalesce("node_cluster", F.lit(structural)).alias("node_cluster"))


def lift_tree(tree: DataFrame, leaves: DataFrame, strays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A condensed tree (cluster, parent, birth, stability, size) and its leaves (node_id, home, level) with nodes that have no vector as one more child of the root, born and left at level 0."""
    top = tree.agg((F.max("cluster") + 1).alias("cluster"), F.max(F.when(F.col("parent") < 0, F.col("cluster"))).alias("root"))
    n = strays.agg(F.count("*").alias("size"))
    extra = top.crossJoin(n).filter("size > 0").select("cluster", F.col("root").alias("parent"), F.lit(0.0).alias("birth"), F.lit(0.0).alias("stability"), "size")  # one row
    homes = strays.crossJoin(F.broadcast(extra.select("cluster"))).select("node_id", F.col("cluster").alias("home"), F.lit(0.0).alias("level"))
    return tree.unionByName(extra), leaves.unionByName(homes)


def bridged_pairs(nodes: DataFrame, edges: DataFrame, min_ghost_degree: int = 2) -> DataFrame:
    """``(a, b)``: pairs of other nodes linked to one ghost, without a link or a common neighbour of their own.

    Pairs are limited to the neighbours of a ghost, which citations keep few.
    """
    both = _both(edges)
    g = nodes.filter("is_ghost").select(F.col("node_id").alias("g"))
    real = both.join(g, both["a"] == g["g"], "left_anti").join(g, both["b"] == g["g"], "left_anti")
    at = both.join(g, both["a"] == g["g"], "left_semi").join(g, both["b"] == g["g"], "left_anti").select(F.col("a").alias("ghost"), F.col("b").alias("r"))
    enough = at.groupBy("ghost").agg(F.count("*").alias("k")).filter(F.col("k") >= min_ghost_degree).select("ghost")
    at = at.join(enough, "ghost", "left_semi")
    x, y = at.select("ghost", F.col("r").alias("a")), at.select("ghost", F.col("r").alias("b"))
    pairs = x.join(y, "ghost").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(real, ["a", "b"], "left_anti")
    # A common neighbour: two links from the pair's ends, looked up for these pairs only.
    na, nb = real.select("a", F.col("b").alias("c")), real.select(F.col("a").alias("b"), F.col("b").alias("c"))
    common = pairs.join(na, "a").join(nb, ["b", "c"]).select("a", "b").distinct()
    return pairs.join(common, ["a", "b"], "left_anti")


def rewire(nodes: DataFrame, edges: DataFrame, seed: int = 1, max_rounds: int = 200) -> DataFrame:
    """``(src, dst)``, once for each link of a ghost: every ghost keeps its number of links to other nodes but gets other partners, picked by a seeded hash among all positioned nodes; links between ghosts stay.

    Where two picks of a ghost meet, further ones are drawn until it has its number. A ghost linked to every node can't have others and gets all of them.
    """
    return rewired(nodes, edges, [seed], max_rounds).select("src", "dst")


def rewired(nodes: DataFrame, edges: DataFrame, seeds: list[int], max_rounds: int = 200) -> DataFrame:
    """``(run, src, dst)``: ``rewire`` for each of several seeds, runs being numbered from 0; their picks are drawn together."""
    g = nodes.filter("is_ghost").select(F.col("node_id").alias("g"))
    both = _both(edges)
    at = both.join(g, both["a"] == g["g"], "left_semi")
    between = at.join(g, at["b"] == g["g"], "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    real = nodes.filter("base_pos is not null").select("node_id")
    total = real.count()
    slots = cut(numbered(real, "node_id", "slot").select("slot", F.col("node_id").alias("dst")))
    outside = at.join(g, at["b"] == g["g"], "left_anti").groupBy(F.col("a").alias("src")).agg(F.count("*").alias("wanted"))
    runs = F.explode(F.array(*(F.struct(F.lit(i).alias("run"), F.lit(s).alias("seed")) for i, s in enumerate(seeds))))
    want = cut(outside.select("src", F.least("wanted", F.lit(total)).alias("wanted"), runs.alias("r")).select("r.run", "r.seed", "src", "wanted"))
    got = cut(want.select("run", "src", F.lit(0).cast("long").alias("dst")).limit(0))
    for turn in range(max_rounds):
        lack = want.join(got.groupBy("run", "src").agg(F.count("*").alias("n")), ["run", "src"], "left").fillna(0, ["n"]).filter("n < wanted")
        if lack.isEmpty():
            return got.unionByName(between.withColumn("run", F.explode(F.array(*(F.lit(i) for i in range(len(seeds)))))))
        drawn = lack.select("run", "seed", "src", F.explode(F.sequence(F.lit(1).cast("long"), F.col("wanted") - F.col("n"))).alias("i")).select("run", "src", F.pmod(F.xxhash64("src", "i", "seed", F.lit(turn)), F.lit(max(total, 1))).alias("slot"))
        new = drawn.join(slots, "slot").select("run", "src", "dst").distinct().join(got, ["run", "src", "dst"], "left_anti")
        got = cut(got.unionByName(new))
    raise RuntimeError(f"ghosts lack partners after {max_rounds} rounds")
