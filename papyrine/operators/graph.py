"""Graph operators on edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of all nodes on an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the set of edges, then a set of stars, doesn't change; the number of rounds grows with the
    logarithm of the largest component. Self-loops keep a node, null ends are dropped.
    """
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"))  # used twice; what it comes from may be costly
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    state = cut(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour is tied to the smallest neighbour
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't found after {max_rounds} rounds")
    roots = state.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def symmetric(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every edge in both directions, once, without self-loops."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    return both.filter("a <> b").distinct()


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """``(id, hops)`` of the nodes at most ``most`` steps from ``start`` (id); each step joins the frontier only, nodes seen are left out."""
    both = cut(symmetric(edges))
    seen = cut(start.select("id", F.lit(0).alias("hops")))
    front = seen
    for k in range(1, most + 1):
        nxt = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        front = cut(nxt.select("id", F.lit(k).alias("hops")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def common_sources(edges: DataFrame) -> DataFrame:
    """``(a, b, n)``, a < b: how many nodes point at both; for graphs between clusters."""
    x, y = edges.select(F.col("a").alias("from"), F.col("b").alias("a")), edges.select(F.col("a").alias("from"), "b")
    return x.join(y, "from").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def minimum_spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(src, dst, w)``: Borůvka's rounds over the whole graph; in each, every component takes its lightest edge to another.

    Equal weights are told apart by the ends, so the forest is unique. Rounds at least halve the components; edges within a component are dropped.
    """
    e = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))
    live = cut(e.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    tree = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        one = F.struct("w", "src", "dst")
        ends = live.select("a", one.alias("e")).unionByName(live.select(F.col("b").alias("a"), one.alias("e")))
        pick = cut(ends.groupBy("a").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.w").distinct())
        tree = pick if tree is None else tree.unionByName(pick)
        joined = live.join(pick.select("src", "dst"), ["src", "dst"], "left_semi").select("a", "b")
        comp = connected_components(joined, "a", "b")
        ca, cb = (comp.select(F.col("id").alias(c), F.col("component").alias("n" + c)) for c in "ab")
        live = cut(live.join(ca, "a", "left").join(cb, "b", "left").select("src", "dst", "w", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).filter("a <> b"))
    else:
        raise RuntimeError(f"the forest isn't complete after {max_rounds} rounds")
    return tree if tree is not None else e.limit(0)


def hop_neighbours(edges: DataFrame, nodes: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``(src, dst, hops)``: for every node k others, the fewest steps away first, among equals by a seeded hash; nodes whose component holds
    fewer get hashed others at one step more than the furthest.

    Any k of a layer will do, so a node passes on at most 2 k of its neighbours and hubs don't multiply. Each step brings a node that still wants others one at least,
    or its component is exhausted; so there are k steps at most.
    """
    from pyspark.sql import Window

    order = F.xxhash64("a", "b", F.lit(seed))
    few = symmetric(edges).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(order, "b"))).filter(F.col("r") <= 2 * k).select("a", "b")
    few = cut(few)
    found = cut(few.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("hops")))
    best = Window.partitionBy("src").orderBy("hops", F.xxhash64("src", "dst", F.lit(seed)), "dst")
    found = cut(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
    front = found
    for h in range(2, k + 1):
        wanting = found.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") < k).select("src")
        reached = front.join(wanting, "src", "left_semi").join(few, front["dst"] == few["a"]).select("src", F.col("b").alias("dst")).filter("src <> dst").distinct()
        front = cut(reached.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
    total = nodes.count()
    slots = nodes.select(F.col("node_id").alias("dst"), F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(max(1, total))).alias("slot"))
    have = nodes.select(F.col("node_id").alias("src")).join(found.groupBy("src").agg(F.count("*").alias("n"), F.max("hops").alias("far")), "src", "left").fillna(0, ["n", "far"])
    asked = have.filter(F.col("n") < k).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4 * k)))).withColumn("slot", F.pmod(F.xxhash64("src", "i", F.lit(seed)), F.lit(max(1, total))))
    padding = asked.join(slots, "slot").filter("src <> dst").select("src", "dst", (F.col("far") + 1).alias("hops")).distinct().join(found, ["src", "dst"], "left_anti")
    both = found.unionByName(padding)
    return both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("src", "dst", "hops")
