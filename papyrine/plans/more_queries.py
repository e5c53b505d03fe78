"""Queries on subsets, time order, origins and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import clustering, graph, hdbscan, labels, search
from papyrine.operators.numbering import running_sum
from papyrine.plans.registry import LEVELS, NODE_EDGES, NODES, query
from papyrine.plans.tables import SCORES, Domain
from papyrine.session import cut
from papyrine.sources import carving, mixture


@query("d9_newer_older_pairs", f"WITH {NODES}, n AS (SELECT is_ghost, t FROM nodes1 WHERE t IS NOT NULL) SELECT a.is_ghost AS newer_ghost, b.is_ghost AS older_ghost, count(*) AS pairs FROM n a JOIN n b ON a.t < b.t GROUP BY ALL")
def newer_older_pairs(spark, d):
    """Pairs of a newer (smaller t) and an older node, counted by what they are without forming them: times are few, nodes many."""
    n = Domain(spark, d).nodes.filter("t is not null").groupBy("t", "is_ghost").agg(F.count("*").alias("k"))
    wide = n.groupBy("t").agg(F.sum(F.when(F.col("is_ghost"), F.col("k")).otherwise(0)).alias("g"), F.sum(F.when(F.col("is_ghost"), 0).otherwise(F.col("k"))).alias("r"))
    w = running_sum(running_sum(wide, "t", F.col("g"), "og", True), "t", F.col("r"), "orr", True)
    w = w.select("t", "g", "r", (F.col("og") - F.col("g")).alias("og"), (F.col("orr") - F.col("r")).alias("orr"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a == "g").alias("newer_ghost"), F.lit(b == "og").alias("older_ghost"), (F.col(a) * F.col(b)).alias("pairs")) for a in ("g", "r") for b in ("og", "orr")))).alias("p")
    return w.select(pairs).groupBy("p.newer_ghost", "p.older_ghost").agg(F.sum("p.pairs").alias("pairs")).filter("pairs > 0")


@query("e10_origins")
def origins(spark, d):
    nodes, orig = mixture.mixture(spark)
    n = nodes.groupBy(F.col("origin_id").alias("id")).agg(F.count("*").alias("n"))
    rms = F.sqrt(F.aggregate("spread", F.lit(0.0), lambda s, x: s + x * x) / 3)
    return orig.join(n, "id").select("id", "n", F.round(rms, 6).alias("rms_spread"))


@query("e15_stability_summary")
def stability_summary(spark, d):
    e = Domain(spark, d).raw("embeddings")
    ref = cut(hdbscan.cluster(e, "vec_id", "embedding", min_size=15))
    s = clustering.stability_summary(clustering.bootstrap(e, "vec_id", "embedding", ref, min_size=8))
    return s.select(F.round("macro", 6).alias("macro"), F.round("unweighted", 6).alias("unweighted"), "stable", "doubtful", "unstable")


@query("k4_hop_neighbours")
def hop_neighbours(spark, d):
    dom = Domain(spark, d)
    return graph.hop_neighbours(dom.node_edges, dom.nodes, 5)


@query("l16_within_parents")
def within_parents(spark, d):
    e = Domain(spark, d).raw("embeddings")
    parents = e.select(F.col("vec_id").alias("node_id"), F.col("label").alias("node_cluster"))
    return clustering.within_parents(e, "vec_id", "embedding", parents, min_size=5)


@query("m6_ladder_levels")
def ladder_levels(spark, d):
    return hdbscan.ladder_levels(Domain(spark, d).raw("embeddings"), "vec_id", "embedding", 5)


@query("o8_layout_sweep")
def layout_sweep(spark, d):
    dom = Domain(spark, d)
    r = search.layout_sweep(cut(dom.nodes), cut(dom.node_edges), dom.positions)
    return r.withColumn("correlation", F.round("correlation", 4))


@query("label_available", "SELECT * FROM (VALUES ('representative', 'needs vectors'), ('year', 'needs years')) v(method, reason)")
def label_available(spark, d):
    t = Domain(spark, d).raw("documents").select("text")
    return spark.createDataFrame([(m, r) for m, r in labels.available(t, None, None).items() if r], "method string, reason string")


_SEL = "sel AS (SELECT a.node_id FROM leveled a JOIN scores s USING (level_uid, node_cluster) WHERE a.level_no = 2 AND s.score >= 4)"


def _selected(dom: Domain):
    s = dom.scores.filter("level_no = 2 and score >= 4")
    return dom.assign.join(s, ["level_uid", "node_cluster"], "left_semi").select("node_id")


@query("x_induced_edges", f"WITH {NODE_EDGES}, {LEVELS}, {SCORES}, {_SEL} SELECT src, dst FROM ne SEMI JOIN sel a ON a.node_id = src SEMI JOIN sel b ON b.node_id = dst")
def induced_edges(spark, d):
    dom = Domain(spark, d)
    return carving.induced_edges(dom.node_edges, cut(_selected(dom)))


@query("x_contracted_edges", f"""WITH {NODE_EDGES}, g AS (SELECT node_id FROM nodes1 WHERE is_ghost), k AS (SELECT src, dst FROM ne ANTI JOIN g a ON a.node_id = src ANTI JOIN g b ON b.node_id = dst),
    i AS (SELECT src, dst AS mid FROM ne SEMI JOIN g a ON a.node_id = dst ANTI JOIN g b ON b.node_id = src), o AS (SELECT src AS mid, dst FROM ne SEMI JOIN g a ON a.node_id = src ANTI JOIN g b ON b.node_id = dst)
    SELECT src, dst FROM k UNION SELECT i.src, o.dst FROM i JOIN o USING (mid) WHERE i.src <> o.dst""")
def contracted_edges(spark, d):
    dom = Domain(spark, d)
    return carving.contracted_edges(dom.node_edges, dom.nodes.filter("is_ghost").select("node_id"))


@query("x_ghost_candidates", f"WITH {NODES}, p AS (SELECT DISTINCT c.citing_id AS known_id, c.cited_id AS unknown_id FROM citations c JOIN nodes1 g ON g.paper_id = c.cited_id AND g.is_ghost WHERE c.citing_id IS NOT NULL) SELECT unknown_id AS paper_id, count(*) AS degree FROM p GROUP BY 1 HAVING count(*) >= 2")
def ghost_candidates(spark, d):
    dom = Domain(spark, d)
    g = dom.nodes.filter("is_ghost").select(F.col("paper_id").alias("cited_id"))
    pending = dom.raw("citations").filter("citing_id is not null").join(g, "cited_id", "left_semi").select(F.col("citing_id").alias("known_id"), F.col("cited_id").alias("unknown_id"))
    return carving.ghost_candidates(pending)
