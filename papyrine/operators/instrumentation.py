"""What nodes without a position of their own do to smoothed vectors: variance, energy of links, bridges against chance, displacement of the others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.dimred import diffuse
from papyrine.operators.ghosts import bridged_pairs, rewired
from papyrine.operators.numbering import numbered
from papyrine.session import cut


def squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def link_energy(vectors: DataFrame, edges: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``(kind, links, energy, per_link)``: sums of squared distances over links, by how many ends are ghosts; self-loops don't count."""
    g = ghosts.select("node_id", F.lit(1).alias("g"))
    v = vectors.join(g, "node_id", "left").fillna(0, ["g"])
    a, b = (v.select(F.col("node_id").alias(e), F.col("vec").alias(f"v{e}"), F.col("g").alias(f"g{e}")) for e in ("src", "dst"))
    j = edges.select("src", "dst").filter("src <> dst").join(a, "src").join(b, "dst").select((F.col("gsrc") + F.col("gdst")).alias("g"), squared("vsrc", "vdst").alias("e"))
    kind = F.when(F.col("g") == 0, "real-real").when(F.col("g") == 1, "real-ghost").otherwise("ghost-ghost").alias("kind")
    return j.groupBy(kind).agg(F.count("*").alias("links"), F.sum("e").alias("energy"), F.avg("e").alias("per_link"))


def variances(vectors: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``(channel, real, ghost)``: variances of every channel over the nodes and over the ghosts; groups of one have none."""
    v = vectors.join(ghosts.select("node_id", F.lit(True).alias("g")), "node_id", "left").select(F.coalesce("g", F.lit(False)).alias("g"), F.posexplode("vec").alias("channel", "v"))
    return v.groupBy("channel").agg(F.var_pop(F.when(~F.col("g"), F.col("v"))).alias("real"), F.coalesce(F.var_pop(F.when(F.col("g"), F.col("v"))), F.lit(0.0)).alias("ghost"))


def variance_ratios(vectors: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``(real, ghost, ratio, channel_ratio)``: mean variances, their ratio and the mean of the channels' ratios; channels that hardly vary don't count in it."""
    fine = F.col("real") > 1e-12
    out = variances(vectors, ghosts).agg(F.avg("real").alias("real"), F.avg("ghost").alias("ghost"), F.avg(F.when(fine, F.col("ghost") / F.col("real"))).alias("channel_ratio"))
    return out.select("real", "ghost", F.when(F.col("real") > 1e-12, F.col("ghost") / F.col("real")).alias("ratio"), "channel_ratio")


def _at_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    a, b = (vectors.select(F.col("node_id").alias(e), F.col("vec").alias(f"v{e}")) for e in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.sqrt(squared("va", "vb")).alias("dist"))


def pair_signal(pairs: DataFrame, vectors: DataFrame, labels: DataFrame, by: Column | None = None) -> DataFrame:
    """``(pairs, mean_dist, together)``: how far pairs lie apart, and the share of them with both in one cluster; for each value of ``by``, where that is given."""
    x, y = (labels.select(F.col("node_id").alias(e), F.col("node_cluster").alias(f"c{e}")) for e in "ab")
    j = _at_pairs(pairs, vectors).join(x, "a", "left").join(y, "b", "left")
    j = j.groupBy() if by is None else j.groupBy(by)
    return j.agg(F.count("*").alias("pairs"), F.avg("dist").alias("mean_dist"), F.avg(F.coalesce((F.col("ca") == F.col("cb")).cast("int"), F.lit(0))).alias("together"))


def bridge_signal(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, label: Callable[[DataFrame], DataFrame], alpha: float = 0.3, iterations: int = 4, min_ghost_degree: int = 2, nulls: int = 8, seed: int = 12345, label_runs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(pairs, mean_dist, together, null_dist, null_together, ratio, lift)``: pairs that share a ghost, after smoothing with the links there are and with ghosts linked at random.

    ``vectors``: (node_id, vec) of the nodes that have one; ``label`` clusters smoothed vectors ``(node_id, vec)`` into ``(node_id, node_cluster)``. The random linkings are
    smoothed and compared together, every node standing in them once a run under a number of its own; ``label_runs`` clusters them together too, by their column ``run``,
    else ``label`` goes through them one by one.
    """
    g = nodes.filter("is_ghost").select("node_id")
    ends = g.select(F.col("node_id").alias("g"))
    plain = cut(edges.select("src", "dst").join(ends, F.col("src") == F.col("g"), "left_anti").join(ends, F.col("dst") == F.col("g"), "left_anti"))
    pairs = cut(bridged_pairs(nodes, edges, min_ghost_degree))
    fused = cut(diffuse(vectors, edges, alpha, iterations, ghosts=g))
    real = cut(pair_signal(pairs, fused, label(fused.join(g, "node_id", "left_anti"))))

    places = cut(numbered(nodes.select("node_id").distinct(), "node_id", "place"))
    every = F.explode(F.array(*(F.lit(i) for i in range(nulls)))).alias("run")

    def apart(df: DataFrame, *names: str) -> DataFrame:
        """The nodes in these columns under their numbers of the run."""
        for c in names:
            df = df.join(places.withColumnRenamed("node_id", c), c).withColumn(c, F.col("place") * nulls + F.col("run")).drop("place")
        return df

    own = F.pmod("node_id", F.lit(nulls)).alias("run")
    strays = cut(apart(g.select("node_id", every), "node_id").select("node_id"))
    links = plain.select(every, "src", "dst").unionByName(rewired(nodes, edges, [seed + 7919 * t for t in range(nulls)]))
    fused = cut(diffuse(apart(vectors.select("node_id", "vec", every), "node_id").drop("run"), apart(links, "src", "dst"), alpha, iterations, ghosts=strays))
    free = fused.join(strays, "node_id", "left_anti").select("node_id", "vec", own)
    labels = label_runs(free) if label_runs else reduce(DataFrame.unionByName, [label(free.filter(F.col("run") == i).select("node_id", "vec")) for i in range(nulls)])
    chance = cut(pair_signal(apart(pairs.select("a", "b", every), "a", "b"), fused, labels, F.pmod("a", F.lit(nulls)).alias("run")))
    null = chance.agg(F.avg("mean_dist").alias("null_dist"), F.avg("together").alias("null_together"))
    return real.crossJoin(null).select("*", (F.col("mean_dist") / F.col("null_dist")).alias("ratio"), (F.col("together") - F.col("null_together")).alias("lift"))  # one row each


def spread_pairs(nodes: DataFrame, step: int = 7919, start: int = 13) -> DataFrame:
    """``(a, b)``: as many pairs as nodes, each node with the one at a place that step and start give; no node with itself, no pair twice."""
    at = cut(numbered(nodes.select("node_id").distinct(), "node_id", "r"))
    m = at.count()
    if m < 2:
        return at.select(F.col("node_id").alias("a"), F.col("node_id").alias("b")).limit(0)
    other = at.select(F.col("r").alias("q"), F.col("node_id").alias("o"))
    j = at.withColumn("q", F.pmod(F.col("r") * step + start, F.lit(m))).join(other, "q").filter("node_id <> o")
    return j.select(F.least("node_id", "o").alias("a"), F.greatest("node_id", "o").alias("b")).distinct()


def contamination(with_ghosts: DataFrame, without: DataFrame) -> DataFrame:
    """``(nodes, mean_moved, pairs, rank_correlation)``: how far ghosts move the others, and whether distances between them keep their order."""
    b = cut(without.select("node_id", F.col("vec").alias("w")))
    j = with_ghosts.select("node_id", "vec").join(b, "node_id")
    moved = j.agg(F.count("*").alias("nodes"), F.avg(F.sqrt(squared("vec", "w"))).alias("mean_moved"))
    pairs = cut(spread_pairs(b))
    x = _at_pairs(pairs, with_ghosts).withColumnRenamed("dist", "x")
    y = _at_pairs(pairs, without).withColumnRenamed("dist", "y")
    both = cut(x.join(y, ["a", "b"]))
    return moved.crossJoin(both.agg(F.count("*").alias("pairs"))).crossJoin(rank_correlation(both, "x", "y"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(rank_correlation)`` of two columns, equal values sharing their mean rank; ranks come from the counts of distinct values, summed up by ranges."""
    from papyrine.operators.numbering import running_sum

    def ranks(c: str) -> DataFrame:
        k = df.groupBy(c).agg(F.count("*").alias("m"))
        return running_sum(k, c, F.col("m"), "upto").select(c, (F.col("upto") - (F.col("m") - 1) / 2).alias(f"rank_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("rank_correlation"))


def report(variance: DataFrame, energy: DataFrame, signal: DataFrame, moved: DataFrame) -> str:
    """A text of the four results, which are a few rows."""
    v, s, m = variance.first(), signal.first(), moved.first()
    number = lambda x: "none" if x is None else f"{x:.4f}"
    lines = [
        f"Variance: nodes {number(v['real'])}, ghosts {number(v['ghost'])}, ratio {number(v['ratio'])} (by channel {number(v['channel_ratio'])}); far below 1: ghosts collapse.",
        *(f"Energy of a link, {r['kind']}: {number(r['per_link'])} over {r['links']}." for r in energy.orderBy("kind").collect()),
        f"Bridged pairs: {s['pairs']}, distance {number(s['mean_dist'])} (by chance {number(s['null_dist'])}, ratio {number(s['ratio'])}), in one cluster {number(s['together'])} (by chance {number(s['null_together'])}, lift {number(s['lift'])}).",
        f"Displacement of the others: {number(m['mean_moved'])}, order of {m['pairs']} distances kept at {number(m['rank_correlation'])}.",
    ]
    return "\n".join(lines)
