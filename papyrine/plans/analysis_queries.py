"""Queries on nodes, clusters and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.operators import analytics, metrics
from papyrine.plans.registry import ASSIGN, EDGES, LEVELS, NODE_EDGES, NODES, POSITIONS, query
from papyrine.plans.tables import SCORES, Domain
from papyrine.session import cut

_SHARES = """pairs AS (SELECT f.level_no AS fine_level, c.level_no AS coarse_level, f.node_cluster AS fine, c.node_cluster AS coarse, count(*) AS n
    FROM leveled f JOIN leveled c ON f.node_id = c.node_id AND c.level_no < f.level_no WHERE f.node_cluster >= 0 GROUP BY ALL),
  shares AS (SELECT *, n / sum(n) OVER w AS fraction, row_number() OVER (PARTITION BY fine_level, coarse_level, fine ORDER BY n DESC, coarse) AS rk, count(*) OVER w AS span
    FROM pairs WINDOW w AS (PARTITION BY fine_level, coarse_level, fine)),
  bridge AS (SELECT fine_level, coarse_level, fine, sum(n) AS size, max(span) AS span, max(CASE WHEN rk = 1 THEN coarse END) AS dominant, max(CASE WHEN rk = 1 THEN fraction END) AS df FROM shares GROUP BY ALL)"""


# --- selection ---------------------------------------------------------------------------------------------------

@query("c1_embedded_nodes", f"WITH {NODES} SELECT node_id, paper_id, row_number() OVER (ORDER BY node_id) - 1 AS row_no FROM nodes1 WHERE NOT is_ghost AND base_pos IS NOT NULL")
def embedded_nodes(spark, d):
    # Row numbers without one sorted partition: offsets of range partitions are added to numbers within them.
    n = Domain(spark, d).nodes.filter("not is_ghost and base_pos is not null").select("node_id", "paper_id")
    part = cut(n.repartitionByRange(F.col("node_id")).withColumn("part", F.spark_partition_id()))  # numbers of partitions must not change between uses
    w = Window.partitionBy("part").orderBy("node_id")
    part = part.withColumn("k", F.row_number().over(w) - 1)
    sizes = part.groupBy("part").agg(F.count("*").alias("size")).withColumn("offset", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    return part.join(sizes.select("part", "offset"), "part").select("node_id", "paper_id", (F.col("offset") + F.col("k")).alias("row_no"))


@query("c2_ghost_nodes", f"WITH {NODES} SELECT node_id, paper_id FROM nodes1 WHERE is_ghost")
def ghost_nodes(spark, d):
    return Domain(spark, d).nodes.filter("is_ghost").select("node_id", "paper_id")


@query("c4_edge_endpoints", f"""WITH {NODES}, e AS (SELECT DISTINCT citing_id, cited_id FROM citations WHERE citing_id IS NOT NULL AND cited_id IS NOT NULL)
    SELECT count(*) AS edges, count(*) FILTER (WHERE a.node_id IS NOT NULL AND b.node_id IS NOT NULL) AS kept, count(*) FILTER (WHERE a.node_id IS NULL OR b.node_id IS NULL) AS dropped,
      count(*) FILTER (WHERE a.node_id IS NOT NULL AND b.node_id IS NOT NULL AND (a.is_ghost OR b.is_ghost)) AS ghost_edges
    FROM e LEFT JOIN nodes1 a ON a.paper_id = e.citing_id LEFT JOIN nodes1 b ON b.paper_id = e.cited_id""")
def edge_endpoints(spark, d):
    dom = Domain(spark, d)
    e = dom.raw("citations").select("citing_id", "cited_id").dropna().distinct()
    n = dom.nodes
    a = n.select(F.col("paper_id").alias("citing_id"), F.col("is_ghost").alias("ga"))
    b = n.select(F.col("paper_id").alias("cited_id"), F.col("is_ghost").alias("gb"))
    j = e.join(a, "citing_id", "left").join(b, "cited_id", "left")
    known = F.col("ga").isNotNull() & F.col("gb").isNotNull()
    return j.agg(F.count("*").alias("edges"), F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped"), F.count_if(known & (F.col("ga") | F.col("gb"))).alias("ghost_edges"))


@query("c5_select_by_score", f"WITH {LEVELS}, {SCORES} SELECT a.level_uid, a.node_id, a.node_cluster FROM leveled a JOIN scores s USING (level_uid, node_cluster) WHERE s.score >= 4")
def select_by_score(spark, d):
    dom = Domain(spark, d)
    return dom.assign.join(dom.scores.filter("score >= 4"), ["level_uid", "node_cluster"]).select("level_uid", "node_id", "node_cluster")


@query("c5_select_cluster", f"WITH {LEVELS} SELECT node_id, node_cluster FROM leveled WHERE level_no = 2 AND node_cluster = 0")
def select_cluster(spark, d):
    return Domain(spark, d).level(2).filter("node_cluster = 0")


_ELIGIBLE = """elig AS (SELECT b.fine_level, b.fine, max(b.span) AS span, max(b.df) AS df, max(CASE WHEN s.coarse = b.dominant AND p.score >= 3 THEN 1 ELSE 0 END) AS dominant_ok, max(CASE WHEN p.score >= 3 THEN 1 ELSE 0 END) AS any_ok
    FROM bridge b JOIN shares s USING (fine_level, coarse_level, fine) LEFT JOIN scores p ON p.level_no = b.coarse_level AND p.node_cluster = s.coarse WHERE b.coarse_level = b.fine_level - 1 GROUP BY ALL),
  boxed AS (SELECT *, span >= 2 AND df < 0.8 AS bridge, CASE WHEN span >= 2 AND df < 0.8 THEN any_ok = 1 ELSE dominant_ok = 1 END AS eligible FROM elig)"""


def _eligible(spark, d, threshold: int = 3, tau: float = 0.8):
    dom = Domain(spark, d)
    s = analytics.level_pairs(dom.assign, dom.levels, adjacent=True)
    p = dom.scores.select(F.col("level_no").alias("coarse_level"), F.col("node_cluster").alias("coarse"), "score")
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False))
    first = F.col("rank") == 1
    g = s.join(p, ["coarse_level", "coarse"], "left").groupBy("fine_level", "fine").agg(
        F.max("span").alias("span"), F.max(F.when(first, F.col("fraction"))).alias("df"), F.max(first & ok).alias("dominant_ok"), F.max(ok).alias("any_ok"))
    bridge = (F.col("span") >= 2) & (F.col("df") < tau)
    return g.select("fine_level", "fine", bridge.alias("bridge"), F.when(bridge, F.col("any_ok")).otherwise(F.col("dominant_ok")).alias("eligible"))


@query("c6_score_eligibility", f"WITH {LEVELS}, {_SHARES}, {SCORES}, {_ELIGIBLE} SELECT fine_level, fine, bridge, eligible FROM boxed")
def score_eligibility(spark, d):
    return _eligible(spark, d)


@query("c7_buckets", f"WITH {LEVELS}, {_SHARES}, {SCORES}, {_ELIGIBLE} SELECT fine_level, CASE WHEN eligible THEN 0 ELSE 2 END + CASE WHEN bridge THEN 1 ELSE 0 END AS bucket, count(*) AS clusters FROM boxed GROUP BY ALL")
def buckets(spark, d):
    b = F.when(F.col("eligible"), 0).otherwise(2) + F.when(F.col("bridge"), 1).otherwise(0)
    return _eligible(spark, d).groupBy("fine_level", b.alias("bucket")).agg(F.count("*").alias("clusters"))


@query("c8_bridges_under_tau", f"WITH {LEVELS}, {_SHARES}, taus AS (SELECT unnest([0.5, 0.65, 0.8, 0.95]) AS tau) SELECT fine_level, coarse_level, tau::DOUBLE AS tau, count(*) FILTER (WHERE span >= 2 AND df < tau) AS bridges FROM bridge, taus GROUP BY ALL")
def bridges_under_tau(spark, d):
    dom = Domain(spark, d)
    b = analytics.bridges(analytics.level_pairs(dom.assign, dom.levels)).withColumn("tau", F.explode(F.array(*(F.lit(t) for t in (0.5, 0.65, 0.8, 0.95)))))
    return b.groupBy("fine_level", "coarse_level", "tau").agg(F.count_if((F.col("span") >= 2) & (F.col("dominant_fraction") < F.col("tau"))).alias("bridges"))


@query("c9_cart_text_filter", "SELECT row_id FROM cart WHERE contains(lower(coalesce(title, '')), 'hydro') OR contains(lower(coalesce(venue, '')), 'hydro') OR contains(lower(coalesce(authors, '')), 'hydro')")
def cart_text_filter(spark, d):
    hit = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("hydro")) for c in ("title", "venue", "authors")]
    return Domain(spark, d).cart.filter(hit[0] | hit[1] | hit[2]).select("row_id")


@query("c10_cart_first_wins", "SELECT paper_id, row_id, source FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY added_at, row_id) AS rn FROM cart) WHERE rn = 1")
def cart_first_wins(spark, d):
    first = F.min(F.struct("added_at", "row_id", "source")).alias("f")
    return Domain(spark, d).cart.groupBy("paper_id").agg(first).select("paper_id", "f.row_id", "f.source")


@query("c12_score_upsert", f"""WITH {LEVELS}, {SCORES}, new AS (SELECT level_uid, node_cluster, 5 AS score FROM scores WHERE score = 4)
    SELECT s.level_uid, s.node_cluster, coalesce(n.score, s.score) AS score FROM scores s LEFT JOIN new n USING (level_uid, node_cluster) WHERE coalesce(n.score, s.score) > 1""")
def score_upsert(spark, d):
    from papyrine.operators.selection import upsert_scores

    s = Domain(spark, d).scores.select("level_uid", "node_cluster", "score")
    new = s.filter("score = 4").select("level_uid", "node_cluster", F.lit(5).alias("score"))
    cleared = s.filter("score = 1").select("level_uid", "node_cluster", F.lit(None).cast("int").alias("score"))
    return upsert_scores(s, new.unionByName(cleared))


@query("c13_contract_violations", f"""WITH {NODES}, {ASSIGN} SELECT 'ghost with position' AS rule, count(*) FILTER (WHERE is_ghost AND base_pos IS NOT NULL) AS violations FROM nodes1
    UNION ALL SELECT 'node without usable position', count(*) FILTER (WHERE NOT is_ghost AND base_pos IS NULL) FROM nodes1
    UNION ALL SELECT 't outside 0 to 1', count(*) FILTER (WHERE t IS NULL OR NOT (t >= 0 AND t <= 1)) FROM nodes1
    UNION ALL SELECT 'ghost before the last node', (SELECT count(*) FROM nodes1 WHERE is_ghost AND node_id < (SELECT max(node_id) FROM nodes1 WHERE NOT is_ghost))
    UNION ALL SELECT 'assignment of an unknown node', (SELECT count(*) FROM assign a ANTI JOIN nodes1 n ON a.node_id = n.node_id)
    UNION ALL SELECT 'cluster below -1', (SELECT count(*) FROM assign WHERE node_cluster < -1)
    UNION ALL SELECT 'self-citation', (SELECT count(*) FROM citations WHERE citing_id = cited_id)""")
def contract_violations(spark, d):
    from papyrine.operators.validation import violations

    dom = Domain(spark, d)
    return violations(dom.nodes, dom.assign, dom.raw("citations"))


# --- joins -------------------------------------------------------------------------------------------------------

@query("d10_ghost_nearest", f"""WITH {NODE_EDGES}, pos AS (SELECT node_id FROM nodes1 WHERE base_pos IS NOT NULL),
    bothways AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), c AS (SELECT b.node_id AS nb, g.node_id AS ghost, count(*) OVER (PARTITION BY g.node_id) AS neighbours, g.t AS gt, n.t AS nt FROM bothways e JOIN nodes1 g ON g.node_id = e.a AND g.is_ghost JOIN pos b ON b.node_id = e.b JOIN nodes1 n ON n.node_id = e.b)
    SELECT ghost, nb AS nearest, neighbours FROM (SELECT *, row_number() OVER (PARTITION BY ghost ORDER BY abs(gt - nt), nb) AS rn FROM c) WHERE rn = 1""")
def ghost_nearest(spark, d):
    from papyrine.operators.ghosts import nearest_neighbour

    dom = Domain(spark, d)
    return nearest_neighbour(dom.nodes, dom.node_edges)


@query("d11_ghost_labels", f"""WITH {NODE_EDGES}, {LEVELS}, bothways AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne),
    c AS (SELECT g.node_id AS ghost, n.node_id AS nb, row_number() OVER (PARTITION BY g.node_id ORDER BY abs(g.t - n.t), n.node_id) AS rn FROM bothways e JOIN nodes1 g ON g.node_id = e.a AND g.is_ghost JOIN nodes1 n ON n.node_id = e.b AND n.base_pos IS NOT NULL)
    SELECT g.node_id, coalesce(a.node_cluster, -1) AS node_cluster FROM nodes1 g LEFT JOIN c ON c.ghost = g.node_id AND c.rn = 1 LEFT JOIN leveled a ON a.node_id = c.nb AND a.level_no = 2 WHERE g.is_ghost""")
def ghost_labels(spark, d):
    from papyrine.operators.ghosts import inherit_labels

    dom = Domain(spark, d)
    return inherit_labels(dom.nodes, dom.node_edges, dom.level(2))


@query("d12_cart_columns", f"""WITH {NODES}, {LEVELS}, lv AS (SELECT node_id, max(CASE WHEN level_no = 0 THEN node_cluster END) AS level_0, max(CASE WHEN level_no = 1 THEN node_cluster END) AS level_1, max(CASE WHEN level_no = 2 THEN node_cluster END) AS level_2, max(CASE WHEN level_no = 3 THEN node_cluster END) AS level_3 FROM leveled GROUP BY node_id),
    {EDGES}, deg AS (SELECT cited_id, count(*) AS cited_by FROM edges GROUP BY 1)
    SELECT c.row_id, c.paper_id, coalesce(n.node_id, -1) AS node_id, coalesce(deg.cited_by, 0) AS cited_by, coalesce(level_0, -2) AS level_0, coalesce(level_1, -2) AS level_1, coalesce(level_2, -2) AS level_2, coalesce(level_3, -2) AS level_3, n.base_pos[1] AS px FROM cart c LEFT JOIN nodes1 n ON n.paper_id = c.paper_id LEFT JOIN deg ON deg.cited_id = c.paper_id LEFT JOIN lv ON lv.node_id = n.node_id""")
def cart_columns(spark, d):
    dom = Domain(spark, d)
    lv = dom.assign.join(dom.levels.select("level_uid", "level_no"), "level_uid").groupBy("node_id").pivot("level_no", [0, 1, 2, 3]).agg(F.max("node_cluster"))
    lv = lv.select("node_id", *(F.col(str(i)).alias(f"level_{i}") for i in range(4)))
    deg = dom.edges.groupBy(F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("cited_by"))
    n = dom.nodes.select("paper_id", "node_id", F.get("base_pos", F.lit(0)).alias("px"))
    out = dom.cart.select("row_id", "paper_id").join(n, "paper_id", "left").join(deg, "paper_id", "left").join(lv, "node_id", "left")
    return out.select("row_id", "paper_id", F.coalesce("node_id", F.lit(-1)).alias("node_id"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"), *(F.coalesce(f"level_{i}", F.lit(-2)).alias(f"level_{i}") for i in range(4)), "px")


@query("d13_bridged_pairs", f"""WITH {NODE_EDGES}, bothways AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), g AS (SELECT node_id FROM nodes1 WHERE is_ghost),
    real AS (SELECT e.* FROM bothways e ANTI JOIN g ON g.node_id = e.a ANTI JOIN g g2 ON g2.node_id = e.b), gr AS (SELECT e.a AS ghost, e.b AS r FROM bothways e SEMI JOIN g ON g.node_id = e.a ANTI JOIN g g2 ON g2.node_id = e.b),
    p AS (SELECT DISTINCT x.r AS a, y.r AS b FROM gr x JOIN gr y ON x.ghost = y.ghost AND x.r < y.r), shared AS (SELECT DISTINCT x.b AS a, y.b AS b FROM real x JOIN real y ON x.a = y.a AND x.b < y.b)
    SELECT p.a, p.b FROM p ANTI JOIN real e ON e.a = p.a AND e.b = p.b ANTI JOIN shared s ON s.a = p.a AND s.b = p.b""")
def bridged_pairs(spark, d):
    from papyrine.operators.ghosts import bridged_pairs as run

    dom = Domain(spark, d)
    return run(dom.nodes, dom.node_edges)


@query("d16_authors", "SELECT row_id, trim(a) AS author FROM (SELECT row_id, unnest(string_split(authors, ';')) AS a FROM cart WHERE authors IS NOT NULL) WHERE trim(a) <> ''")
def authors(spark, d):
    return Domain(spark, d).cart.select("row_id", F.explode(F.split("authors", ";")).alias("a")).select("row_id", F.trim("a").alias("author")).filter("author <> ''")


# --- aggregations ------------------------------------------------------------------------------------------------

@query("e1_centroids", f"""WITH {POSITIONS}, {ASSIGN} SELECT level_uid, node_cluster, count(*) AS n, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz,
    round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) AS spread FROM assign JOIN pos USING (node_id) WHERE node_cluster >= 0 GROUP BY ALL""")
def centroids(spark, d):
    dom = Domain(spark, d)
    c = analytics.centroids(dom.positions, dom.assign, ["level_uid", "node_cluster"])
    return c.select("level_uid", "node_cluster", "n", *(F.round(x, 4).alias(x) for x in ("cx", "cy", "cz", "spread")))


@query("e2_cluster_sizes", f"WITH {ASSIGN} SELECT level_uid, count(DISTINCT node_cluster) FILTER (WHERE node_cluster >= 0) AS clusters, count(*) AS nodes, count(*) FILTER (WHERE node_cluster = -1) AS noise, round(avg(CASE WHEN node_cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_fraction FROM assign GROUP BY 1")
def cluster_sizes(spark, d):
    per = Domain(spark, d).assign.groupBy("level_uid", "node_cluster").agg(F.count("*").alias("n"))
    noise = F.sum(F.when(F.col("node_cluster") == -1, F.col("n")).otherwise(0))
    return per.groupBy("level_uid").agg(F.count_if(F.col("node_cluster") >= 0).alias("clusters"), F.sum("n").alias("nodes"), noise.alias("noise"), F.round(noise / F.sum("n"), 6).alias("noise_fraction"))


@query("e3_in_degree", f"WITH {NODE_EDGES}, deg AS (SELECT dst, count(*) AS k FROM ne GROUP BY 1) SELECT n.node_id, coalesce(k, 0) AS in_deg FROM nodes1 n LEFT JOIN deg ON deg.dst = n.node_id")
def in_degree(spark, d):
    dom = Domain(spark, d)
    return analytics.in_degree(dom.nodes, dom.node_edges)


_FLOW = "flow AS (SELECT x.level_uid, x.node_cluster AS a, y.node_cluster AS b, count(*) AS links FROM ne JOIN assign x ON x.node_id = src AND x.node_cluster >= 0 JOIN assign y ON y.node_id = dst AND y.level_uid = x.level_uid AND y.node_cluster >= 0 GROUP BY ALL)"


def _flow(spark, d):
    dom = Domain(spark, d)
    return analytics.flow(dom.assign, dom.node_edges)


@query("e4_cross_cluster_flow", f"WITH {NODE_EDGES}, {ASSIGN}, {_FLOW} SELECT * FROM flow")
def cross_cluster_flow(spark, d):
    return _flow(spark, d)


@query("e4_cluster_degrees", f"""WITH {NODE_EDGES}, {ASSIGN}, {_FLOW}, e AS (SELECT level_uid, a AS node_cluster, sum(CASE WHEN a <> b THEN links ELSE 0 END) AS o, 0 AS i, sum(CASE WHEN a = b THEN links ELSE 0 END) AS s FROM flow GROUP BY ALL
    UNION ALL SELECT level_uid, b, 0, sum(CASE WHEN a <> b THEN links ELSE 0 END), 0 FROM flow GROUP BY ALL)
    SELECT level_uid, node_cluster, sum(o)::BIGINT AS out_deg, sum(i)::BIGINT AS in_deg, sum(s)::BIGINT AS intra FROM e GROUP BY ALL""")
def cluster_degrees(spark, d):
    return analytics.flow_degrees(_flow(spark, d))


@query("e4_edges_used", f"WITH {NODE_EDGES}, {ASSIGN}, {_FLOW}, t AS (SELECT count(*) AS n FROM ne) SELECT level_uid, sum(links)::BIGINT AS used, (max(t.n) - sum(links))::BIGINT AS dropped FROM flow, t GROUP BY 1")
def edges_used(spark, d):
    dom = Domain(spark, d)
    total = dom.node_edges.agg(F.count("*").alias("total"))  # one row
    used = analytics.flow(dom.assign, dom.node_edges).groupBy("level_uid").agg(F.sum("links").alias("used"))
    return used.crossJoin(F.broadcast(total)).select("level_uid", "used", (F.col("total") - F.col("used")).alias("dropped"))


@query("e5_out_fraction", f"WITH {NODE_EDGES}, {ASSIGN}, {_FLOW} SELECT level_uid, a, b, round(links / sum(links) OVER (PARTITION BY level_uid, a), 6) AS fraction FROM flow")
def out_fraction(spark, d):
    return analytics.out_fractions(_flow(spark, d)).withColumn("fraction", F.round("fraction", 6))


@query("e6_bridge_analysis", f"WITH {LEVELS}, {_SHARES} SELECT fine_level, coarse_level, fine, size::BIGINT AS size, span, dominant, round(df, 6) AS dominant_fraction, span >= 2 AS is_bridge FROM bridge")
def bridge_analysis(spark, d):
    dom = Domain(spark, d)
    b = analytics.bridges(analytics.level_pairs(dom.assign, dom.levels))
    return b.select("fine_level", "coarse_level", "fine", "size", "span", "dominant", F.round("dominant_fraction", 6).alias("dominant_fraction"), "is_bridge")


@query("e6_boundary_scores", f"WITH {LEVELS}, {_SHARES} SELECT a.node_id, b.fine_level, b.coarse_level, round(1 - b.df, 6) AS boundary FROM leveled a JOIN bridge b ON b.fine_level = a.level_no AND b.fine = a.node_cluster")
def boundary_scores(spark, d):
    dom = Domain(spark, d)
    b = analytics.bridges(analytics.level_pairs(dom.assign, dom.levels)).select("fine_level", "coarse_level", F.col("fine").alias("node_cluster"), F.round(1 - F.col("dominant_fraction"), 6).alias("boundary"))
    a = dom.assign.join(dom.levels.select("level_uid", F.col("level_no").alias("fine_level")), "level_uid")
    return a.join(b, ["fine_level", "node_cluster"]).select("node_id", "fine_level", "coarse_level", "boundary")


@query("e7_bridges_all_layers", f"WITH {LEVELS}, {_SHARES} SELECT fine_level, count(*) FILTER (WHERE span >= 2) AS bridges, count(*) AS clusters FROM bridge WHERE coarse_level = fine_level - 1 GROUP BY 1")
def bridges_all_layers(spark, d):
    dom = Domain(spark, d)
    b = analytics.bridges(analytics.level_pairs(dom.assign, dom.levels, adjacent=True))
    return b.groupBy("fine_level").agg(F.count_if("is_bridge").alias("bridges"), F.count("*").alias("clusters"))


@query("e8_bridges_per_pair", f"""WITH {LEVELS}, s AS (SELECT f.level_no AS fine_level, c.level_no AS coarse_level, f.node_cluster AS fine, count(DISTINCT c.node_cluster) AS span FROM leveled f JOIN leveled c ON f.node_id = c.node_id AND c.level_no < f.level_no
    WHERE f.node_cluster >= 0 AND c.node_cluster >= 0 GROUP BY ALL) SELECT fine_level, coarse_level, count(*) FILTER (WHERE span >= 2) AS bridges FROM s GROUP BY ALL""")
def bridges_per_pair(spark, d):
    dom = Domain(spark, d)
    return analytics.bridge_counts(dom.assign, dom.levels)


@query("e9_contingency", f"WITH {LEVELS} SELECT coalesce(a.node_cluster, -9) AS a, coalesce(b.node_cluster, -9) AS b, count(*) AS n FROM leveled a JOIN leveled b ON a.node_id = b.node_id AND a.level_no = 0 AND b.level_no = 2 GROUP BY CUBE (a.node_cluster, b.node_cluster)")
def contingency(spark, d):
    dom = Domain(spark, d)
    j = dom.level(0).withColumnRenamed("node_cluster", "a").join(dom.level(2).withColumnRenamed("node_cluster", "b"), "node_id")
    return j.cube("a", "b").agg(F.count("*").alias("n")).select(F.coalesce("a", F.lit(-9)).alias("a"), F.coalesce("b", F.lit(-9)).alias("b"), "n")


@query("e11_year_bins", f"WITH {NODES}, r AS (SELECT min(year) AS lo, max(year) AS hi FROM nodes1) SELECT coalesce(least(floor((year - lo) / (hi - lo) * 10), 9), 0)::INT AS bin, count(*) AS n FROM nodes1, r GROUP BY 1")
def year_bins(spark, d):
    n = Domain(spark, d).nodes
    r = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))  # one row
    return n.crossJoin(F.broadcast(r)).groupBy(analytics.ten_bins((F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("bin")).agg(F.count("*").alias("n"))


@query("e12_degree_stats", f"WITH {NODE_EDGES}, deg AS (SELECT dst, count(*) AS k FROM ne GROUP BY 1), y AS (SELECT min(year) AS first_year, max(year) AS last_year FROM nodes1) SELECT first_year, last_year, max(k) AS most, round(ln(1 + max(k)), 6) AS log_most FROM deg, y GROUP BY ALL")
def degree_stats(spark, d):
    dom = Domain(spark, d)
    y = dom.nodes.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    deg = dom.node_edges.groupBy("dst").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"))
    return y.crossJoin(deg).select("first_year", "last_year", "most", F.round(F.log1p("most"), 6).alias("log_most"))


@query("e13_year_spans", f"WITH {NODES}, {ASSIGN} SELECT level_uid, node_cluster, count(year) AS n, min(year) AS first_year, max(year) AS last_year, list_sort(list(year))[count(year) // 2 + 1] AS median FROM assign JOIN nodes1 USING (node_id) WHERE node_cluster >= 0 AND year IS NOT NULL GROUP BY ALL")
def year_spans(spark, d):
    # The upper median by counting: years are few, members of a cluster may be many.
    dom = Domain(spark, d)
    y = dom.assign.filter("node_cluster >= 0").join(dom.nodes.filter("year is not null").select("node_id", "year"), "node_id").groupBy("level_uid", "node_cluster", "year").agg(F.count("*").alias("k"))
    w = Window.partitionBy("level_uid", "node_cluster")
    y = y.withColumn("upto", F.sum("k").over(w.orderBy("year"))).withColumn("n", F.sum("k").over(w))
    return y.groupBy("level_uid", "node_cluster").agg(F.max("n").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("year"))).alias("median"))


@query("e14_mean_sd", f"WITH {POSITIONS}, {ASSIGN} SELECT level_uid, round(avg(k), 6) AS mean_size, round(stddev_pop(k), 6) AS sd_size FROM (SELECT level_uid, node_cluster, count(*) AS k FROM assign WHERE node_cluster >= 0 GROUP BY ALL) GROUP BY 1")
def mean_sd(spark, d):
    per = Domain(spark, d).assign.filter("node_cluster >= 0").groupBy("level_uid", "node_cluster").agg(F.count("*").alias("k"))
    return per.groupBy("level_uid").agg(F.round(F.avg("k"), 6).alias("mean_size"), F.round(F.stddev_pop("k"), 6).alias("sd_size"))


@query("e17_channel_variance", "SELECT i AS channel, round(var_pop(v), 9) AS variance FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1")
def channel_variance(spark, d):
    e = Domain(spark, d).raw("embeddings").select(F.posexplode("embedding").alias("channel", "v"))
    return e.groupBy(F.col("channel").cast("long").alias("channel")).agg(F.round(F.var_pop(F.col("v").cast("double")), 9).alias("variance"))


@query("e18_coverage", "SELECT count(*) AS row_count, count(title) AS titles, count(year) AS years, count(venue) AS venues, count(doi) AS dois, count(node_id) AS with_node, count(in_deg) AS degrees FROM cart")
def coverage(spark, d):
    return Domain(spark, d).cart.agg(F.count("*").alias("row_count"), *(F.count(c).alias(a) for c, a in (("title", "titles"), ("year", "years"), ("venue", "venues"), ("doi", "dois"), ("node_id", "with_node"), ("in_deg", "degrees"))))


@query("e19_picked_layer_bridges", f"""WITH {LEVELS}, s AS (SELECT f.level_no AS fl, c.level_no AS cl, f.node_cluster AS fine, count(DISTINCT c.node_cluster) AS span FROM leveled f JOIN leveled c ON f.node_id = c.node_id AND c.level_no < f.level_no WHERE f.node_cluster >= 0 AND c.node_cluster >= 0 GROUP BY ALL),
    b AS (SELECT fl, cl, count(*) FILTER (WHERE span >= 2) AS bridges FROM s GROUP BY ALL), p AS (SELECT level_no, lag(level_no) OVER (ORDER BY level_no) AS above FROM level_info WHERE level_no IN (0, 2, 3)) SELECT level_no AS fine_level, above AS coarse_level, bridges FROM p JOIN b ON fl = level_no AND cl = above""")
def picked_layer_bridges(spark, d):
    dom = Domain(spark, d)
    picked = dom.levels.filter(F.col("level_no").isin(0, 2, 3)).select(F.col("level_no").alias("fine_level"), F.lag("level_no").over(Window.orderBy("level_no")).alias("coarse_level"))
    return analytics.bridge_counts(dom.assign, dom.levels).join(picked, ["fine_level", "coarse_level"]).select("fine_level", "coarse_level", "bridges")


# --- ranking -----------------------------------------------------------------------------------------------------

@query("f3_rank_correlation", f"""WITH {NODE_EDGES}, deg AS (SELECT dst, count(*) AS k FROM ne GROUP BY 1), v AS (SELECT t, coalesce(k, 0) AS k FROM nodes1 LEFT JOIN deg ON dst = node_id WHERE t IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS a, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS b FROM v) SELECT round(corr(a, b), 6) AS rho FROM r""")
def rank_correlation(spark, d):
    # Mean ranks of the distinct values, from their counts summed up by ranges: no window over all rows.
    from papyrine.operators.numbering import running_sum

    dom = Domain(spark, d)
    v = analytics.in_degree(dom.nodes, dom.node_edges).join(dom.nodes.filter("t is not null").select("node_id", "t"), "node_id")

    def ranks(c):
        k = v.groupBy(c).agg(F.count("*").alias("m"))
        return running_sum(k, c, F.col("m"), "upto").select(c, (F.col("upto") - (F.col("m") - 1) / 2).alias(f"r_{c}"))

    return v.join(ranks("t"), "t").join(ranks("in_deg"), "in_deg").agg(F.round(F.corr("r_t", "r_in_deg"), 6).alias("rho"))


@query("f4_dominant_shares", f"WITH {LEVELS}, {_SHARES} SELECT fine_level, coarse_level, fine, coarse, round(fraction, 6) AS fraction FROM shares WHERE rk = 1")
def dominant_shares(spark, d):
    dom = Domain(spark, d)
    return analytics.level_pairs(dom.assign, dom.levels).filter("rank = 1").select("fine_level", "coarse_level", "fine", "coarse", F.round("fraction", 6).alias("fraction"))


@query("f7_dense_relabel", f"WITH {ASSIGN}, m AS (SELECT level_uid, node_cluster, min(node_id) AS f FROM assign WHERE node_cluster >= 0 GROUP BY ALL) SELECT level_uid, node_cluster, row_number() OVER (PARTITION BY level_uid ORDER BY f) - 1 AS label FROM m")
def dense_relabel(spark, d):
    m = Domain(spark, d).assign.filter("node_cluster >= 0").groupBy("level_uid", "node_cluster").agg(F.min("node_id").alias("f"))
    return m.select("level_uid", "node_cluster", (F.row_number().over(Window.partitionBy("level_uid").orderBy("f")) - 1).alias("label"))


@query("f8_first_edge_wins", """SELECT citing_id, cited_id FROM (SELECT *, row_number() OVER (PARTITION BY least(citing_id, cited_id), greatest(citing_id, cited_id) ORDER BY discovered, arrived_at, citing_id) AS rn
    FROM citations WHERE citing_id IS NOT NULL AND cited_id IS NOT NULL AND citing_id <> cited_id) WHERE rn = 1""")
def first_edge_wins(spark, d):
    from papyrine.sources.importers import materialise

    return materialise(Domain(spark, d).raw("citations"))


@query("g1_top_in_degree", f"WITH {NODE_EDGES} SELECT dst AS node_id, count(*) AS in_deg FROM ne GROUP BY 1 ORDER BY in_deg DESC, node_id LIMIT 50")
def top_in_degree(spark, d):
    return Domain(spark, d).node_edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_deg")).orderBy(F.desc("in_deg"), "node_id").limit(50)


@query("g2_top_links", f"WITH {NODE_EDGES}, {ASSIGN}, {_FLOW} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY level_uid ORDER BY links DESC, a, b) AS rn FROM flow WHERE a <> b) WHERE rn <= 8")
def top_links(spark, d):
    w = Window.partitionBy("level_uid").orderBy(F.desc("links"), "a", "b")
    return _flow(spark, d).filter("a <> b").withColumn("rn", F.row_number().over(w)).filter("rn <= 8").drop("rn")


@query("g7_sorted_nulls_last", "SELECT row_id, coalesce(in_deg, -1) AS in_deg FROM cart ORDER BY in_deg DESC NULLS LAST, row_id LIMIT 100")
def sorted_nulls_last(spark, d):
    return Domain(spark, d).cart.select("row_id", "in_deg").orderBy(F.desc_nulls_last("in_deg"), "row_id").limit(100).select("row_id", F.coalesce("in_deg", F.lit(-1)).alias("in_deg"))


# --- sets --------------------------------------------------------------------------------------------------------

@query("h1_cluster_jaccard", f"""WITH {LEVELS}, c AS (SELECT a.node_cluster AS a, b.node_cluster AS b, count(*) AS n FROM leveled a JOIN leveled b ON a.node_id = b.node_id AND a.level_no = 2 AND b.level_no = 3 WHERE a.node_cluster >= 0 AND b.node_cluster >= 0 GROUP BY ALL),
    sa AS (SELECT node_cluster AS a, count(*) AS na FROM leveled WHERE level_no = 2 GROUP BY 1), sb AS (SELECT node_cluster AS b, count(*) AS nb FROM leveled WHERE level_no = 3 GROUP BY 1) SELECT a, b, round(n / (na + nb - n), 6) AS jaccard FROM c JOIN sa USING (a) JOIN sb USING (b)""")
def cluster_jaccard(spark, d):
    dom = Domain(spark, d)
    a, b = dom.level(2).withColumnRenamed("node_cluster", "a"), dom.level(3).withColumnRenamed("node_cluster", "b")
    c = a.filter("a >= 0").join(b.filter("b >= 0"), "node_id").groupBy("a", "b").agg(F.count("*").alias("n"))
    sa, sb = a.groupBy("a").agg(F.count("*").alias("na")), b.groupBy("b").agg(F.count("*").alias("nb"))
    return c.join(sa, "a").join(sb, "b").select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


@query("h2_symmetrised", f"WITH {NODE_EDGES} SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne")
def symmetrised(spark, d):
    e = Domain(spark, d).node_edges
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


_AB = "a AS (SELECT node_id, node_cluster AS a FROM leveled WHERE level_no = 2), b AS (SELECT node_id, node_cluster AS b FROM leveled WHERE level_no = 3), ab AS (SELECT a, b, count(*) AS n FROM a JOIN b USING (node_id) GROUP BY ALL)"


@query("h3_retention", f"WITH {LEVELS}, {_AB}, t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na FROM ab) SELECT node_id, CASE WHEN na > 1 THEN round((n - 1) / (na - 1), 6) END AS retention FROM a JOIN b USING (node_id) JOIN t USING (a, b)")
def node_retention(spark, d):
    dom = Domain(spark, d)
    a, b = (dom.level(i).select("node_id", F.col("node_cluster").alias(c), F.lit(1).alias("run")) for i, c in ((2, "a"), (3, "b")))
    return metrics.retention(a, b, metrics.contingency(a, b, ["run"]), ["run"]).select("node_id", F.round("retention", 6).alias("retention"))


_SCORED = """m AS (SELECT x.level_no AS first_level, y.level_no AS second_level, x.node_cluster AS a, y.node_cluster AS b, count(*)::DOUBLE AS n FROM leveled x JOIN leveled y ON x.node_id = y.node_id AND x.level_no < y.level_no GROUP BY ALL),
    ma AS (SELECT first_level, second_level, a, sum(n) AS n FROM m GROUP BY ALL), mb AS (SELECT first_level, second_level, b, sum(n) AS n FROM m GROUP BY ALL),
    k AS (SELECT first_level, second_level, sum(n) AS n, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS lc FROM m GROUP BY ALL), ka AS (SELECT first_level, second_level, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS l FROM ma GROUP BY ALL),
    kb AS (SELECT first_level, second_level, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS l FROM mb GROUP BY ALL),
    s AS (SELECT k.first_level, k.second_level, k.n, k.c, ka.c AS ca, kb.c AS cb, ka.c * kb.c / (k.n * (k.n - 1) / 2) AS e, ln(k.n) - ka.l / k.n AS ha, ln(k.n) - kb.l / k.n AS hb, ln(k.n) + (k.lc - ka.l - kb.l) / k.n AS mi FROM k JOIN ka USING (first_level, second_level) JOIN kb USING (first_level, second_level))"""


def _level_tables(dom: Domain):
    # A node's clusters come together once; the pairs of its levels are made beside each other instead of by a join.
    a = dom.assign.join(F.broadcast(dom.levels.select("level_uid", "level_no")), "level_uid")  # a handful of levels
    own = a.groupBy("node_id").agg(F.collect_list(F.struct("level_no", "node_cluster")).alias("own"))
    pairs = own.select("own", F.explode("own").alias("x")).select("x", F.explode("own").alias("y")).filter("x.level_no < y.level_no")
    t = pairs.select(F.col("x.level_no").alias("first_level"), F.col("y.level_no").alias("second_level"), F.col("x.node_cluster").alias("a"), F.col("y.node_cluster").alias("b"))
    return t.groupBy("first_level", "second_level", "a", "b").agg(F.count("*").alias("n"))


@query("n1_n2_ari_nmi", f"WITH {LEVELS}, {_SCORED} SELECT first_level, second_level, n::BIGINT AS n, round((c - e) / ((ca + cb) / 2 - e), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / sqrt(ha * hb), 6) AS nmi_geometric FROM s")
def ari_nmi(spark, d):
    s = metrics.scores(_level_tables(Domain(spark, d)), ["first_level", "second_level"])
    return s.select("first_level", "second_level", "n", *(F.round(c, 6).alias(c) for c in ("ari", "nmi", "nmi_geometric")))


@query("n3_ami")
def ami(spark, d):
    t = _level_tables(Domain(spark, d)).withColumn("pair", F.concat_ws("-", "first_level", "second_level"))
    return metrics.ami(t, "pair").withColumn("ami", F.round("ami", 6))


@query("n4_matched_jaccard")
def matched_jaccard(spark, d):
    t = _level_tables(Domain(spark, d)).filter("second_level = first_level + 1 and a >= 0 and b >= 0").withColumn("pair", F.concat_ws("-", "first_level", "second_level"))
    return metrics.matched_jaccard(t, "pair", 3).withColumn("jaccard", F.round("jaccard", 6)).withColumn("class", metrics.jaccard_class(F.col("jaccard")))


@query("n14_verdict", f"WITH {LEVELS}, {_SCORED} SELECT first_level, second_level, CASE WHEN (c - e) / ((ca + cb) / 2 - e) > 0.85 THEN 'strong' WHEN (c - e) / ((ca + cb) / 2 - e) > 0.5 THEN 'moderate' ELSE 'substantial' END AS verdict FROM s")
def verdict(spark, d):
    s = metrics.scores(_level_tables(Domain(spark, d)), ["first_level", "second_level"])
    return s.select("first_level", "second_level", metrics.verdict(F.col("ari")).alias("verdict"))


@query("n9_partition_comparison", f"""WITH {LEVELS}, {_AB}, t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rk FROM ab)
    SELECT a, na::BIGINT AS size, b AS biggest, n AS kept, (na - n)::BIGINT AS lost, round(n / na, 6) AS share, round(n / (na + nb - n), 6) AS jaccard FROM t WHERE rk = 1 AND a >= 0""")
def partition_comparison(spark, d):
    dom = Domain(spark, d)
    a, b = (dom.level(i).select("node_id", F.col("node_cluster").alias(c)) for i, c in ((2, "a"), (3, "b")))
    t = metrics.contingency(a, b)
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    t = t.select("*", F.sum("n").over(wa).alias("na"), F.sum("n").over(wb).alias("nb"), F.row_number().over(wa.orderBy(F.desc("n"), "b")).alias("rk")).filter("rk = 1 and a >= 0")
    return t.select("a", F.col("na").alias("size"), F.col("b").alias("biggest"), F.col("n").alias("kept"), (F.col("na") - F.col("n")).alias("lost"), F.round(F.col("n") / F.col("na"), 6).alias("share"), F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


@query("g4_top_movers", f"WITH {LEVELS}, {_AB}, t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na FROM ab) SELECT node_id, round((n - 1) / (na - 1), 6) AS retention FROM a JOIN b USING (node_id) JOIN t USING (a, b) WHERE na > 1 ORDER BY (n - 1) / (na - 1), node_id LIMIT 20")
def top_movers(spark, d):
    dom = Domain(spark, d)
    a, b = (dom.level(i).select("node_id", F.col("node_cluster").alias(c), F.lit(1).alias("run")) for i, c in ((2, "a"), (3, "b")))
    r = metrics.retention(a, b, metrics.contingency(a, b, ["run"]), ["run"]).filter("retention is not null")
    return r.orderBy("retention", "node_id").limit(20).select("node_id", F.round("retention", 6).alias("retention"))


@query("n12_dirichlet", f"""WITH {NODE_EDGES}, p AS (SELECT node_id, is_ghost, base_pos FROM nodes1 WHERE base_pos IS NOT NULL), q AS (SELECT x.year IS NULL OR y.year IS NULL AS undated, (a.base_pos[1] - b.base_pos[1]) ** 2 + (a.base_pos[2] - b.base_pos[2]) ** 2 + (a.base_pos[3] - b.base_pos[3]) ** 2 AS e
    FROM ne JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst JOIN nodes1 x ON x.node_id = src JOIN nodes1 y ON y.node_id = dst) SELECT undated, count(*) AS edges, round(avg(e), 6) AS energy FROM q GROUP BY 1""")
def dirichlet(spark, d):
    dom = Domain(spark, d)
    p = dom.positions.join(dom.nodes.select("node_id", "year"), "node_id")
    a, b = (p.select(F.col("node_id").alias(k), *(F.col(c).alias(c + k) for c in ("x", "y", "z", "year"))) for k in ("src", "dst"))
    e = sum((F.col(c + "src") - F.col(c + "dst")) ** 2 for c in "xyz")
    j = dom.node_edges.join(a, "src").join(b, "dst").select((F.col("yearsrc").isNull() | F.col("yeardst").isNull()).alias("undated"), e.alias("e"))
    return j.groupBy("undated").agg(F.count("*").alias("edges"), F.round(F.avg("e"), 6).alias("energy"))


# --- recipes -----------------------------------------------------------------------------------------------------

@query("s2_most_cited", f"WITH {EDGES} SELECT cited_id, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, cited_id LIMIT 20")
def most_cited(spark, d):
    Domain(spark, d).edges.createOrReplaceTempView("papyrine_edges")
    return spark.sql("SELECT cited_id, count(*) AS n FROM papyrine_edges GROUP BY cited_id ORDER BY n DESC, cited_id LIMIT 20")


@query("s3_what_a_paper_cites", f"WITH {EDGES}, top AS (SELECT citing_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, citing_id LIMIT 1) SELECT n.paper_id, n.node_id, coalesce(n.year, 0) AS year FROM edges e JOIN top USING (citing_id) JOIN ({NODES.split(' AS ', 1)[1][1:-1]}) n ON n.paper_id = e.cited_id")
def what_a_paper_cites(spark, d):
    dom = Domain(spark, d)
    top = dom.edges.groupBy("citing_id").count().orderBy(F.desc("count"), "citing_id").limit(1).select("citing_id")
    return dom.edges.join(top, "citing_id").join(dom.nodes, F.col("cited_id") == F.col("paper_id")).select("paper_id", "node_id", F.coalesce("year", F.lit(0)).alias("year"))


@query("s4_who_cites_a_paper", f"WITH {EDGES}, top AS (SELECT cited_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, cited_id LIMIT 1) SELECT n.paper_id, n.node_id, coalesce(n.year, 0) AS year FROM edges e JOIN top USING (cited_id) JOIN ({NODES.split(' AS ', 1)[1][1:-1]}) n ON n.paper_id = e.citing_id")
def who_cites_a_paper(spark, d):
    dom = Domain(spark, d)
    top = dom.edges.groupBy("cited_id").count().orderBy(F.desc("count"), "cited_id").limit(1).select("cited_id")
    return dom.edges.join(top, "cited_id").join(dom.nodes, F.col("citing_id") == F.col("paper_id")).select("paper_id", "node_id", F.coalesce("year", F.lit(0)).alias("year"))


@query("s5_counts_by_source", "SELECT coalesce(lower(trim(provenance)), 'none') AS source, count(DISTINCT citing_id) AS citing, count(DISTINCT cited_id) AS cited, count(*) AS n FROM citations GROUP BY 1")
def counts_by_source(spark, d):
    s = F.coalesce(F.lower(F.trim("provenance")), F.lit("none")).alias("source")
    return Domain(spark, d).raw("citations").groupBy(s).agg(F.countDistinct("citing_id").alias("citing"), F.countDistinct("cited_id").alias("cited"), F.count("*").alias("n"))


@query("s6_observed_values", "SELECT paper_id, row_id, venue, added_at FROM cart WHERE venue IS NOT NULL AND paper_id IN (SELECT paper_id FROM cart GROUP BY 1 HAVING count(DISTINCT venue) > 1)")
def observed_values(spark, d):
    c = Domain(spark, d).cart
    differ = c.groupBy("paper_id").agg(F.countDistinct("venue").alias("k")).filter("k > 1")
    return c.filter("venue is not null").join(differ, "paper_id", "left_semi").select("paper_id", "row_id", "venue", "added_at")


@query("s7_fields_in_conflict", """SELECT field, count(*) AS papers FROM (SELECT paper_id, field FROM (SELECT paper_id, 'year' AS field, year::VARCHAR AS v FROM cart UNION ALL SELECT paper_id, 'venue', venue FROM cart UNION ALL SELECT paper_id, 'doi', doi FROM cart) WHERE v IS NOT NULL GROUP BY ALL HAVING count(DISTINCT v) > 1) GROUP BY 1""")
def fields_in_conflict(spark, d):
    c = Domain(spark, d).cart.select("paper_id", F.col("year").cast("string").alias("year"), "venue", "doi")
    long = c.unpivot(["paper_id"], ["year", "venue", "doi"], "field", "v").filter("v is not null")
    return long.groupBy("paper_id", "field").agg(F.countDistinct("v").alias("k")).filter("k > 1").groupBy("field").agg(F.count("*").alias("papers"))


@query("s8_live_disagreements", "SELECT paper_id, count(DISTINCT venue) AS venue_values, count(DISTINCT source) AS sources FROM cart WHERE venue IS NOT NULL GROUP BY 1 HAVING count(DISTINCT venue) > 1 AND count(DISTINCT source) > 1")
def live_disagreements(spark, d):
    c = Domain(spark, d).cart.filter("venue is not null").groupBy("paper_id").agg(F.countDistinct("venue").alias("venue_values"), F.countDistinct("source").alias("sources"))
    return c.filter("venue_values > 1 and sources > 1")


@query("s9_author_counts", "SELECT row_id, len(list_filter(string_split(coalesce(authors, ''), ';'), lambda a: trim(a) <> '')) AS authors FROM cart")
def author_counts(spark, d):
    named = F.filter(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.trim(a) != "")
    return Domain(spark, d).cart.select("row_id", F.size(named).cast("long").alias("authors"))


@query("s11_papers_in_a_field", "SELECT DISTINCT paper_id FROM cart WHERE pub_type IS NOT NULL AND regexp_replace(lower(pub_type), '[^a-z]', '', 'g') = 'conferencepaper'")
def papers_in_a_field(spark, d):
    return Domain(spark, d).cart.filter(F.regexp_replace(F.lower("pub_type"), "[^a-z]", "") == "conferencepaper").select("paper_id").distinct()


@query("i_json_fields", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark, d):
    e = Domain(spark, d).raw("events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("i_cosine_to_centroid", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), c AS (SELECT label, i, avg(x) AS m FROM l GROUP BY ALL)
    SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) AS cosine FROM l JOIN c USING (label, i) GROUP BY vec_id""")
def cosine_to_centroid(spark, d):
    from papyrine.operators import vectors

    e = Domain(spark, d).raw("embeddings")
    return vectors.cosine_to_mean(e, "vec_id", "label", "embedding").select("vec_id", F.round("cosine", 6).alias("cosine"))
