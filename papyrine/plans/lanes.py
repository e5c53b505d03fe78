"""Lanes: the analyses that a change sets off, each returning its tables by name, with checks that stop it loudly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import analytics, clustering, dimred, ghosts, hdbscan, layout, multilevel, validation
from papyrine.session import cut
from papyrine.sources import registry

#: What hangs on a table: a lane that makes it anew drops these.
DOWNSTREAM = {
    "nodes": ("vectors", "assign", "bridges", "stability", "flow", "layout", "labels", "scores"),
    "vectors": ("assign", "bridges", "stability", "flow", "labels", "scores"),
    "assign": ("bridges", "stability", "flow", "labels", "scores"),
    "edges": ("flow", "layout"),
}


def renewed(state: dict, **tables) -> dict:
    """``state`` with new tables, without what hung on the old ones; what it drops is listed as ``stale``."""
    gone = {d for name in tables for d in DOWNSTREAM.get(name, ()) if d in state and d not in tables}
    return {k: v for k, v in state.items() if k not in gone and k != "stale"} | tables | {"stale": sorted(gone)}


def ingest(spark: SparkSession, source: str, state: dict | None = None, **params) -> dict:
    """Reads a source, checks its contract and begins a state from it, everything downstream dropped; raises on a violation."""
    got = registry.read(spark, source, **params)
    nodes = cut(got["nodes"])
    bad = nodes.agg(F.count("*").alias("rows"), F.countDistinct("node_id").alias("ids"), F.count_if(F.col("t").isNull() | ~F.col("t").between(0, 1)).alias("times")).first()
    if bad["rows"] != bad["ids"] or bad["times"]:
        raise ValueError(f"{source}: {bad['rows'] - bad['ids']} nodes repeated, {bad['times']} times outside 0 to 1")
    if "edges" in got:
        loose = got["edges"].join(nodes.select(F.col("node_id").alias("src")), "src", "left_anti").count() + got["edges"].join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti").count()
        if loose:
            raise ValueError(f"{source}: {loose} ends of links are no nodes")
    return renewed(state or {}, **(got | {"nodes": nodes}))


def cluster_lane(state: dict, vectors: DataFrame, ident: str, vector: str, levels: list[dict], prefix: str = "L", bootstrap: dict | None = None, reserve: bool = True) -> dict:
    """Levels of clusters of the vectors, nodes without one following their nearest linked node; bridges between the levels; on request how well the finest level comes back.

    Adds ``assign`` (level_uid, node_id, node_cluster), ``levels`` (level_uid, level_no), ``bridges`` and ``stability``.
    """
    found = cut(clustering.cascade(vectors, ident, vector, levels))
    spark = vectors.sparkSession
    names = spark.createDataFrame([(f"{prefix}{i}", i) for i in range(len(levels))], "level_uid string, level_no int")
    parts = []
    for i in range(len(levels)):
        own = found.filter(F.col("level_no") == i).select("node_id", "node_cluster")
        if "edges" in state:
            follow = ghosts.inherit_labels(state["nodes"], state["edges"], own, reserve=reserve)
            own = own.unionByName(follow.join(own.select("node_id"), "node_id", "left_anti"))
        parts.append(own.select(F.lit(f"{prefix}{i}").alias("level_uid"), "node_id", "node_cluster"))
    assign = cut(reduce(DataFrame.unionByName, parts))
    out = renewed(state, assign=assign, levels=names)
    if len(levels) > 1:
        out["bridges"] = analytics.bridges(analytics.level_pairs(assign, names, adjacent=True))
    if bootstrap is not None:
        last = found.filter(F.col("level_no") == len(levels) - 1).select("node_id", "node_cluster")
        out["stability"] = cut(clustering.bootstrap(vectors, ident, vector, last, **bootstrap))
    return out


def flow_lane(state: dict, edges: DataFrame) -> dict:
    """New links, once each and between different nodes, and what flows between the clusters of each level."""
    clean = cut(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct())
    out = renewed(state, edges=clean)
    return out | {"flow": cut(analytics.flow(out["assign"], clean))} if "assign" in out else out


def layout_lane(state: dict, method: str, base: DataFrame, seed: int = 1) -> dict:
    """A layout of the links, turned component by component onto the positions, in the viewer's scale; adds ``layout`` and ``layout_fit``."""
    bad = validation.layout_violations(base).first()
    if bad["repeated"] or bad["not_finite"]:
        raise ValueError(f"positions: {bad['repeated']} repeated, {bad['not_finite']} not finite")
    placed = cut(layout.layout(method, state["nodes"], state["edges"], seed))
    turned, fit = layout.align_by_component(base, placed, state["edges"])
    return renewed(state, layout=cut(dimred.viewer_scale(turned)), layout_fit=fit)


def sweep_lane(state: dict, vectors: DataFrame, ident: str, vector: str, count: int = 25, min_samples: int = 5, fraction: float = 0.5, **bootstrap) -> dict:
    """Candidates of layers, one for each number of clusters that holds over a run of sizes, each with its partition and how well it comes back.

    Adds ``candidates`` (count, size, width, stability) and ``candidate_labels`` (count, node_id, node_cluster).
    """
    curve = cut(clustering.size_sweep(vectors, ident, vector, count, min_samples))
    picked = cut(multilevel.plateaus(curve))
    sizes = {r["count"]: r["size"] for r in picked.collect()}  # a handful
    if not sizes:
        return state | {"candidates": picked.withColumn("stability", F.lit(None).cast("double")), "candidate_labels": None}
    labels, stable = [], []
    for k, size in sorted(sizes.items()):
        one = cut(hdbscan.cluster(vectors, ident, vector, min_size=size, min_samples=min_samples).select("node_id", "node_cluster"))
        labels.append(one.select(F.lit(k).cast("long").alias("count"), "node_id", "node_cluster"))
        # A cluster of this size shrinks with the subsample; so does the least size.
        each = clustering.bootstrap(vectors, ident, vector, one, fraction=fraction, min_size=max(2, int(size * fraction + 0.5)), min_samples=min_samples, **bootstrap)
        stable.append(clustering.stability_summary(each).select(F.lit(k).cast("long").alias("count"), F.col("macro").alias("stability")))
    scored = picked.join(cut(reduce(DataFrame.unionByName, stable)), "count", "left")
    return state | {"candidates": scored, "candidate_labels": reduce(DataFrame.unionByName, labels)}


def commit_lane(state: dict, counts: list[int], prefix: str = "ML") -> dict:
    """The picked candidates as levels, coarse to fine, and the bridges between them."""
    steps = multilevel.ladder(state["candidates"], counts, prefix)
    assign = cut(state["candidate_labels"].join(steps.select("uid", "count"), "count").select(F.col("uid").alias("level_uid"), "node_id", "node_cluster"))
    levels = steps.select(F.col("uid").alias("level_uid"), F.expr(f"int(substring(uid, {len(prefix) + 3}))").alias("level_no"))
    return renewed(state, assign=assign, levels=levels) | {"bridges": analytics.bridges(analytics.level_pairs(assign, levels, adjacent=True))}


def scoring_prep(state: dict, labels: DataFrame | None = None) -> DataFrame:
    """``(level_uid, node_cluster, size, label, score)``: what a user is to score, all scores empty; noise isn't scored."""
    sizes = state["assign"].filter("node_cluster >= 0").groupBy("level_uid", "node_cluster").agg(F.count("*").alias("size"))
    named = sizes.join(labels.select("level_uid", "node_cluster", "label"), ["level_uid", "node_cluster"], "left") if labels is not None else sizes.withColumn("label", F.lit(None).cast("string"))
    return named.select("level_uid", "node_cluster", "size", F.coalesce("label", F.lit("(unlabelled)")).alias("label"), F.lit(None).cast("int").alias("score"))
