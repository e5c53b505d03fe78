"""Clusterings on neighbour graphs, levels of clusterings, and their reproducibility."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import hdbscan, metrics
from papyrine.operators.graph import connected_components
from papyrine.operators.numbering import numbered
from papyrine.operators.vectors import kmeans, knn, mutual_pairs

#: Parameters of the algorithms: kind, range, scale, the values a sweep tries.
ALGORITHMS = {
    "mutualKNN": {"mutual_k": {"kind": "int", "min": 2, "max": 30, "default": 8, "sweep": [4, 6, 8, 12, 16]}},
    "hdbscan": {"min_size": {"kind": "int", "min": 2, "max": 200, "scale": "log", "default": 15, "sweep": [5, 10, 15, 25, 40]}, "min_samples": {"kind": "int", "min": 1, "max": 50, "default": 5, "sweep": [5]}, "epsilon": {"kind": "float", "min": 0, "max": 10, "default": 0.0, "sweep": [0.0]}},
    "connected-components": {"k": {"kind": "int", "min": 1, "max": 30, "default": 5, "sweep": [3, 5, 8, 12]}},
    "kmeans": {"k": {"kind": "int", "min": 2, "max": 100, "default": 10, "sweep": [5, 10, 20]}},
}


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node_id, node_cluster)`` of components, numbered by their smallest node."""
    own = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    comp = connected_components(links.select("src", "dst").unionByName(own))
    first = numbered(comp.select("component").distinct(), "component", "node_cluster")
    return comp.join(first, "component").select(F.col("id").alias("node_id"), "node_cluster")


def mutual_knn(df: DataFrame, ident: str, vector: str, mutual_k: int = 8, by: str | None = None) -> DataFrame:
    """``(node_id, node_cluster)``: components of the pairs that are among each other's nearest (within the group ``by``)."""
    return _named(df.select(F.col(ident).alias("node_id")), mutual_pairs(knn(df, ident, vector, mutual_k, by=by)))


def knn_components(df: DataFrame, ident: str, vector: str, k: int = 5, either: bool = False) -> DataFrame:
    """``(node_id, node_cluster)``: components of the neighbour links from lower to higher id; with ``either`` of all of them."""
    e = knn(df, ident, vector, k).select("src", "dst")
    return _named(df.select(F.col(ident).alias("node_id")), e if either else e.filter("dst > src"))


def infer(name: str, df: DataFrame, ident: str, vector: str, **params) -> DataFrame:
    if name == "mutualKNN":
        return mutual_knn(df, ident, vector, **params)
    if name == "connected-components":
        return knn_components(df, ident, vector, **params)
    if name == "hdbscan":
        return hdbscan.cluster(df, ident, vector, **params).select("node_id", "node_cluster")
    if name == "kmeans":
        return kmeans(df, ident, vector, **params).select(F.col(ident).alias("node_id"), F.col("cluster").alias("node_cluster"))
    raise KeyError(f"no algorithm {name!r}; there are {', '.join(ALGORITHMS)}")


def within_parents(df: DataFrame, ident: str, vector: str, parents: DataFrame, **params) -> DataFrame:
    """``(node_id, node_cluster)``: every parent cluster of ``parents`` clustered on its own, clusters numbered through in the parents' order."""
    j = df.join(parents.select(F.col("node_id").alias(ident), F.col("node_cluster").alias("parent")), ident)
    inner = hdbscan.cluster(j, ident, vector, by="parent", **params)
    per = inner.groupBy("parent").agg((F.max("node_cluster") + 1).alias("k"))
    offset = per.select("parent", (F.sum("k").over(Window.orderBy("parent")) - F.col("k")).alias("offset"))  # one row a parent
    return inner.join(offset, "parent").select("node_id", (F.col("offset") + F.col("node_cluster")).alias("node_cluster"))


def cascade(df: DataFrame, ident: str, vector: str, levels: list[dict]) -> DataFrame:
    """``(level_no, node_id, node_cluster)`` of levels ``{"scope": "global" | "within-parent", ...parameters}``, coarse to fine."""
    out, above = None, None
    for number, level in enumerate(levels):
        params = {k: v for k, v in level.items() if k != "scope"}
        if level.get("scope", "global") == "global" or above is None:
            one = hdbscan.cluster(df, ident, vector, **params).select("node_id", "node_cluster")
        else:
            one = within_parents(df, ident, vector, above, **params)
        above = one
        row = one.withColumn("level_no", F.lit(number))
        out = row if out is None else out.unionByName(row)
    return out.select("level_no", "node_id", "node_cluster")


def size_sweep(df: DataFrame, ident: str, vector: str, count: int = 25, min_samples: int = 5) -> DataFrame:
    """``(size, count)``: the number of clusters for minimum sizes spaced evenly on a logarithmic scale; one model serves all sizes."""
    from papyrine.operators.search import log_spaced_sizes

    src = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("node_id")["v"].to_numpy())
        model = hdbscan.fit(x, min_samples)
        rows = [(s, len(np.unique(hdbscan.run(x, min_size=s, model=model)[0]))) for s in log_spaced_sizes(len(x), count)]
        return pd.DataFrame(rows, columns=["size", "count"])

    return src.groupBy().applyInPandas(run, "size int, count int")


def bootstrap(df: DataFrame, ident: str, vector: str, reference: DataFrame, rounds: int = 25, fraction: float = 0.5, seed: int = 12345, least: int = 3, noise: str = "exclude", **params) -> DataFrame:
    """``(cluster, members, jaccard, rounds, class)``: how well clusters come back from subsamples, each clustered in a task of its own.

    Subsamples are the rows with the smallest seeded hashes, so they don't depend on partitioning. ``noise``: "exclude", "asCluster" (noise is a cluster of its
    own) or "penalise" (scores times the share of other points).
    """
    n = df.count()
    take = max(2, int(round(n * fraction)))
    rows = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).alias("v")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    w = Window.partitionBy("round").orderBy(F.xxhash64("node_id", "round", F.lit(seed)), "node_id")
    sample = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= take)
    params.setdefault("noise", "keep" if noise == "asCluster" else "absorb")
    found = hdbscan.cluster(sample, "node_id", "v", by="round", **params)
    ref = reference.select("node_id", F.col("node_cluster").alias("a"))
    cand = found.select("round", "node_id", F.col("node_cluster").alias("b"))
    share = reference.agg(F.avg((F.col("node_cluster") == -1).cast("int")).alias("s"))
    if noise != "asCluster":
        ref, cand = ref.filter("a >= 0"), cand.filter("b >= 0")
    table = cand.join(ref, "node_id").groupBy("round", "a", "b").agg(F.count("*").alias("n"))
    each = metrics.matched_jaccard(table, "round", least)
    size = ref.groupBy("a").agg(F.count("*").alias("members"))
    out = size.join(each.groupBy("a").agg(F.avg("jaccard").alias("j"), F.count("*").alias("rounds")), "a", "left")
    j = F.coalesce("j", F.lit(0.0))
    if noise == "penalise":
        out, j = out.crossJoin(F.broadcast(share)), j * (1 - F.coalesce("s", F.lit(0.0)))
    out = out.select(F.col("a").alias("cluster"), "members", j.alias("jaccard"), F.coalesce("rounds", F.lit(0)).alias("rounds"))
    return out.withColumn("class", metrics.jaccard_class(F.col("jaccard")))


def stability_summary(result: DataFrame) -> DataFrame:
    """``(macro, unweighted, stable, doubtful, unstable)`` of ``bootstrap``."""
    return result.agg((F.sum(F.col("jaccard") * F.col("members")) / F.sum("members")).alias("macro"), F.avg("jaccard").alias("unweighted"), *(F.count_if(F.col("class") == c).alias(c) for c in ("stable", "doubtful", "unstable")))


def bayes_labels(nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """``(node_id, origin)``: the origin of the largest posterior for diagonal Gaussians with the origins' shares as priors.

    ``nodes``: (node_id, origin_id, base_pos); ``origins``: (id, centre, spread), a handful of rows.
    """
    prior = nodes.groupBy("origin_id").agg(F.count("*").alias("n"))
    o = origins.join(prior, F.col("id") == F.col("origin_id"), "left").select("id", "centre", "spread", F.log(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1e-9))).alias("prior"))
    terms = [-F.log(F.get("spread", F.lit(i))) - ((F.get("base_pos", F.lit(i)) - F.get("centre", F.lit(i))) / F.get("spread", F.lit(i))) ** 2 / 2 for i in range(3)]
    scored = nodes.select("node_id", "base_pos").crossJoin(F.broadcast(o)).select("node_id", "id", (F.col("prior") + terms[0] + terms[1] + terms[2]).alias("score"))
    return scored.groupBy("node_id").agg(F.max(F.struct("score", (-F.col("id")).alias("m")))["m"].alias("m")).select("node_id", (-F.col("m")).alias("origin"))
