"""Queries on compared partitions, ghosts, neighbourhoods, subsets and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papyrine.functions.colours import SCALES, colour, log_scale
from papyrine.functions.text import FOREIGN_WORDS, STOP_WORDS, is_junk, tokens
from papyrine.operators import clustering, comparison, dimred, export, ghosts, graph, instrumentation, metrics, multilevel, taste, validation, vectors
from papyrine.plans import lanes
from papyrine.plans.analysis_queries import _AB, _SCORED, _level_tables
from papyrine.plans.model_queries import _RIS_SQL, _START, _diffused, _ris, _step
from papyrine.plans.registry import ASSIGN, LEVELS, NODE_EDGES, POSITIONS, SQL, query
from papyrine.plans.tables import Domain
from papyrine.session import cut, ensure_checkpoint_dir
from papyrine.sources import corpus


def _compared(spark, d) -> comparison.Comparison:
    dom = Domain(spark, d)
    return comparison.compare(dom.level(2), dom.level(3))


_RET = """t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na FROM ab), ret AS (SELECT node_id, CASE WHEN a < 0 OR b < 0 THEN NULL WHEN na <= 1 THEN 1.0 ELSE (n - 1) / (na - 1) END AS retention FROM a JOIN b USING (node_id) JOIN t USING (a, b))"""


@query("n9_aggregate", f"""WITH {LEVELS}, {_SCORED}, {_AB}, {_RET}, f AS (SELECT count(DISTINCT a) FILTER (WHERE a >= 0) AS clusters_pre, count(DISTINCT b) FILTER (WHERE b >= 0) AS clusters_post,
    round(sum(n) FILTER (WHERE a < 0) / sum(n), 6) AS noise_pre, round(sum(n) FILTER (WHERE b < 0) / sum(n), 6) AS noise_post FROM ab), g AS (SELECT count(*) FILTER (WHERE retention < 0.5) AS reorganised FROM ret)
    SELECT n::BIGINT AS n, round((c - e) / ((ca + cb) / 2 - e), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / sqrt(ha * hb), 6) AS nmi_geometric, clusters_pre, clusters_post, coalesce(noise_pre, 0) AS noise_pre, coalesce(noise_post, 0) AS noise_post, reorganised FROM s, f, g WHERE first_level = 2 AND second_level = 3""")
def aggregate(spark, d):
    a = _compared(spark, d).summary
    return a.select("n", *(F.round(c, 6).alias(c) for c in ("ari", "nmi", "nmi_geometric")), "clusters_pre", "clusters_post", F.round("noise_pre", 6).alias("noise_pre"), F.round("noise_post", 6).alias("noise_post"), "reorganised")


@query("n9_cluster_moves", f"""WITH {LEVELS}, {_AB}, t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS size, row_number() OVER (PARTITION BY a ORDER BY b >= 0 DESC, n DESC, b) AS rk FROM ab)
    SELECT a::BIGINT AS a, size::BIGINT AS size, b AS biggest, n AS biggest_count FROM t WHERE rk = 1 AND a >= 0""")
def cluster_moves(spark, d):
    return _compared(spark, d).moves


@query("n9_node_retention", f"WITH {LEVELS}, {_AB}, {_RET} SELECT node_id, round(retention, 6) AS retention FROM ret")
def node_retention(spark, d):
    return _compared(spark, d).nodes.select("node_id", F.round("retention", 6).alias("retention"))


@query("b6_top_mover_records", f"""WITH {LEVELS}, {_AB}, {_RET}, top AS (SELECT node_id FROM ret WHERE retention IS NOT NULL ORDER BY retention, node_id LIMIT 20),
    rec AS (SELECT node_id, {_RIS_SQL} AS record, row_number() OVER (PARTITION BY node_id ORDER BY row_id) AS rn FROM cart WHERE node_id IS NOT NULL) SELECT node_id, record FROM top JOIN rec USING (node_id) WHERE rn = 1""")
def top_mover_records(spark, d):
    top = cut(_compared(spark, d).top_movers().select("node_id"))  # twenty rows: only their records are put together
    c = Domain(spark, d).cart.filter("node_id is not null").join(F.broadcast(top), "node_id", "left_semi")
    one = c.groupBy("node_id").agg(F.min(F.struct("row_id", _ris(c).alias("record")))["record"].alias("record"))
    return export.selection_records(top, one)[0]


_KINDS = "k AS (SELECT CASE coalesce(x.is_ghost, FALSE)::INT + coalesce(y.is_ghost, FALSE)::INT WHEN 0 THEN 'real-real' WHEN 1 THEN 'real-ghost' ELSE 'ghost-ghost' END AS kind, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS e FROM ne JOIN s3 a ON a.node_id = src JOIN s3 b ON b.node_id = dst JOIN nodes1 x ON x.node_id = src JOIN nodes1 y ON y.node_id = dst)"
_FUSED = f"{NODE_EDGES}, {_START}, {_step(1)}, {_step(2)}, {_step(3)}"


@query("n12_link_energy", f"WITH {_FUSED}, {_KINDS} SELECT kind, count(*) AS links, round(avg(e), 3) AS per_link FROM k GROUP BY 1")
def link_energy(spark, d):
    dom = Domain(spark, d)
    return instrumentation.link_energy(_diffused(spark, d), dom.node_edges, dom.nodes.filter("is_ghost")).select("kind", "links", F.round("per_link", 3).alias("per_link"))


@query("e17_variance_ratio", f"""WITH {_FUSED}, f AS (SELECT s3.*, is_ghost FROM s3 JOIN nodes1 USING (node_id)), c AS (SELECT unnest([0, 1, 2]) AS channel, unnest([x, y, z]) AS v, is_ghost FROM f WHERE x IS NOT NULL),
    w AS (SELECT channel, var_pop(v) FILTER (WHERE NOT is_ghost) AS r, coalesce(var_pop(v) FILTER (WHERE is_ghost), 0) AS g FROM c GROUP BY 1) SELECT round(avg(g) / avg(r), 5) AS ratio, round(avg(g / r), 5) AS channel_ratio FROM w""")
def variance_ratio(spark, d):
    r = instrumentation.variance_ratios(_diffused(spark, d), Domain(spark, d).nodes.filter("is_ghost"))
    return r.select(F.round("ratio", 5).alias("ratio"), F.round("channel_ratio", 5).alias("channel_ratio"))


_PLAIN = "bwp AS (SELECT e.a, e.b FROM bw0 e SEMI JOIN p m1 ON m1.node_id = e.a SEMI JOIN p m2 ON m2.node_id = e.b), dgp AS (SELECT a, count(*) AS k FROM bwp GROUP BY 1), q0 AS (SELECT * FROM p)"


def _plain_step(i: int) -> str:
    return _step(i).replace(" bw ", " bwp ").replace("JOIN dg ON dg.a", "JOIN dgp dg ON dg.a").replace(f"n{i}", f"m{i}").replace(f"s{i - 1} s", f"q{i - 1} s").replace(f", s{i} AS", f", q{i} AS")


@query("n13_contamination_ranks", f"""WITH {_FUSED}, {_PLAIN}, {_plain_step(1)}, {_plain_step(2)}, {_plain_step(3)}, j AS (SELECT u.node_id, u.x, u.y, u.z, v.x AS x1, v.y AS y1, v.z AS z1 FROM q3 u JOIN s3 v USING (node_id)),
    r AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS r, count(*) OVER () AS m FROM j), pr AS (SELECT DISTINCT least(a.node_id, b.node_id) AS a, greatest(a.node_id, b.node_id) AS b FROM r a JOIN r b ON b.r = (a.r * 7919 + 13) % a.m WHERE a.node_id <> b.node_id),
    ds AS (SELECT sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2 + (f.z - g.z) ** 2) AS w, sqrt((f.x1 - g.x1) ** 2 + (f.y1 - g.y1) ** 2 + (f.z1 - g.z1) ** 2) AS v FROM pr JOIN j f ON f.node_id = pr.a JOIN j g ON g.node_id = pr.b),
    rk AS (SELECT rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS rw, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rv FROM ds)
    SELECT (SELECT count(*) FROM j) AS nodes, (SELECT round(avg(sqrt((x - x1) ** 2 + (y - y1) ** 2 + (z - z1) ** 2)), 3) FROM j) AS mean_moved, count(*) AS pairs, round(corr(rw, rv), 4) AS rank_correlation FROM rk""")
def contamination_ranks(spark, d):
    dom = Domain(spark, d)
    real = dom.nodes.filter("base_pos is not null").select("node_id", F.col("base_pos").alias("vec"))
    c = instrumentation.contamination(cut(_diffused(spark, d)), cut(dimred.diffuse(real, dom.node_edges, 0.5, 3)))
    return c.select("nodes", F.round("mean_moved", 3).alias("mean_moved"), "pairs", F.round("rank_correlation", 4).alias("rank_correlation"))


@query("n13_bridged_pairs_apart", f"""WITH {_FUSED}, {ASSIGN}, bp AS ({SQL["d13_bridged_pairs"]}), l AS (SELECT node_id, node_cluster FROM assign JOIN level_info USING (level_uid) WHERE level_no = 3)
    SELECT count(*) AS pairs, round(avg(sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2 + (f.z - g.z) ** 2)), 3) AS mean_dist, round(avg(coalesce((la.node_cluster = lb.node_cluster)::INT, 0)), 6) AS together
    FROM bp JOIN s3 f ON f.node_id = bp.a JOIN s3 g ON g.node_id = bp.b LEFT JOIN l la ON la.node_id = bp.a LEFT JOIN l lb ON lb.node_id = bp.b""")
def bridged_pairs_apart(spark, d):
    dom = Domain(spark, d)
    s = instrumentation.pair_signal(ghosts.bridged_pairs(dom.nodes, dom.node_edges), _diffused(spark, d), dom.level(3))
    return s.select("pairs", F.round("mean_dist", 3).alias("mean_dist"), F.round("together", 6).alias("together"))


@query("n13_bridge_signal")
def bridge_signal(spark, d):
    dom = Domain(spark, d)
    real = dom.nodes.filter("base_pos is not null").select("node_id", F.col("base_pos").alias("vec"))
    s = instrumentation.bridge_signal(cut(dom.nodes), cut(dom.node_edges), cut(real), lambda v: clustering.mutual_knn(v, "node_id", "vec", 8), label_runs=lambda v: clustering.mutual_knn(v, "node_id", "vec", 8, by="run"))
    return s.select("pairs", *(F.round(c, 4).alias(c) for c in ("mean_dist", "together", "null_dist", "null_together", "ratio", "lift")))


@query("k9_rewired_degrees", f"""WITH {NODE_EDGES}, g AS (SELECT node_id FROM nodes1 WHERE is_ghost), bw AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), t AS (SELECT count(*) AS total FROM nodes1 WHERE base_pos IS NOT NULL),
    o AS (SELECT a, count(*) AS k FROM bw SEMI JOIN g ON g.node_id = a ANTI JOIN g g2 ON g2.node_id = b GROUP BY 1), i AS (SELECT a, count(*) AS k FROM bw SEMI JOIN g ON g.node_id = a SEMI JOIN g g2 ON g2.node_id = b GROUP BY 1)
    SELECT coalesce(o.a, i.a) AS ghost, (least(coalesce(o.k, 0), total) + coalesce(i.k, 0))::BIGINT AS links FROM o FULL JOIN i ON o.a = i.a, t""")
def rewired_degrees(spark, d):
    dom = Domain(spark, d)
    return ghosts.rewire(dom.nodes, dom.node_edges).distinct().groupBy(F.col("src").alias("ghost")).agg(F.count("*").alias("links"))


@query("l17_reserved_cluster", SQL["d11_ghost_labels"].replace("coalesce(a.node_cluster, -1)", "coalesce(a.node_cluster, (SELECT max(node_cluster) + 1 FROM leveled WHERE level_no = 2))"))
def reserved_cluster(spark, d):
    dom = Domain(spark, d)
    return ghosts.inherit_labels(dom.nodes, dom.node_edges, dom.level(2), reserve=True)


_NEAR = f"""{POSITIONS}, {LEVELS}, cl AS (SELECT node_id, node_cluster FROM leveled WHERE level_no = 3 AND node_cluster >= 0), pp AS (SELECT node_id, node_cluster, x, y, z FROM pos JOIN cl USING (node_id)),
    pr AS (SELECT a.node_id AS src, b.node_id AS dst, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 9) AS d2 FROM pp a JOIN pp b ON a.node_cluster = b.node_cluster AND a.node_id <> b.node_id),
    kn AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rk FROM pr) WHERE rk <= 4)"""


@query("d8_cluster_neighbours", f"WITH {_NEAR} SELECT src, dst FROM kn")
def cluster_neighbours(spark, d):
    dom = Domain(spark, d)
    p = dom.level(3).filter("node_cluster >= 0").join(dom.positions, "node_id").select("node_id", "node_cluster", F.array("x", "y", "z").alias("v"))
    return vectors.knn(p, "node_id", "v", 4, by="node_cluster").select("src", "dst")


def _reached(edges: str, nodes: str, steps: int = 60) -> str:
    """A recursive table ``comp`` (id, c): the smallest node each node reaches in so many steps, enough where paths aren't longer."""
    return f"""reach AS (SELECT id, id AS c, 0 AS s FROM {nodes} UNION ALL SELECT id, min(c), max(s) + 1 FROM (SELECT id, c, s FROM reach UNION ALL SELECT e.a, r.c, r.s FROM reach r JOIN {edges} e ON e.b = r.id) WHERE s < {steps} GROUP BY id),
    comp AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)"""


@query("q2_named_neighbourhoods", f"WITH RECURSIVE {_NEAR}, mu AS (SELECT a.src AS a, a.dst AS b FROM kn a JOIN kn b ON a.src = b.dst AND a.dst = b.src), own AS (SELECT node_id AS id FROM pp), {_reached('mu', 'own')} SELECT id AS node_id, node_cluster, c AS neighbourhood FROM comp JOIN pp ON pp.node_id = id")
def named_neighbourhoods(spark, d):
    dom = Domain(spark, d)
    return taste.neighbourhoods(dom.positions, dom.level(3))


@query("k1_named_components", f"WITH RECURSIVE {NODE_EDGES}, bw AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), own AS (SELECT node_id AS id FROM nodes1), {_reached('bw', 'own', 40)} SELECT id, c AS component FROM comp")
def named_components(spark, d):
    dom = Domain(spark, d)
    return graph.connected_components(dom.node_edges.unionByName(dom.nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))))


_TREE = f"""{LEVELS}, l AS (SELECT node_id, level_no, level_no * 1000000::BIGINT + node_cluster AS cluster FROM leveled WHERE node_cluster >= 0), k AS (SELECT f.cluster, f.level_no, c.cluster AS up, count(*) AS n FROM l f LEFT JOIN l c ON c.node_id = f.node_id AND c.level_no = f.level_no - 1 GROUP BY ALL),
    tr AS (SELECT cluster, coalesce(up, 999999999) AS parent, level_no + 1.0 AS birth FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY up IS NULL, n DESC, up) AS rk FROM k) WHERE rk = 1 UNION ALL SELECT 999999999, -1, 0.5)"""


@query("f6_layers", f"""WITH {_TREE}, ch AS (SELECT parent AS cluster, min(birth) AS e FROM tr WHERE parent >= 0 GROUP BY 1), sp AS (SELECT birth AS lo, least(coalesce(e, 5.0), 5.0) AS hi FROM tr LEFT JOIN ch USING (cluster) WHERE parent >= 0),
    ev AS (SELECT level, sum(d) AS d FROM (SELECT lo AS level, 1 AS d FROM sp WHERE hi > lo UNION ALL SELECT hi, -1 FROM sp WHERE hi > lo) GROUP BY 1), sg AS (SELECT level AS lo, lead(level) OVER (ORDER BY level) AS hi, sum(d) OVER (ORDER BY level) AS count FROM ev),
    w AS (SELECT *, ln(hi / lo) AS width FROM sg WHERE hi IS NOT NULL AND count >= 2 AND lo > 0), each AS (SELECT count, sum(width) AS persistence, max_by(sqrt(lo * hi), width) AS level FROM w WHERE width > 0 GROUP BY 1)
    SELECT count::BIGINT AS count, round(level, 6) AS level, round(persistence, 6) AS persistence FROM each ORDER BY persistence DESC, count LIMIT 5""")
def layers(spark, d):
    """Layers of the tree that the four levels make, each cluster below the one most of its nodes are in."""
    dom = Domain(spark, d)
    a = dom.assign.filter("node_cluster >= 0").join(dom.levels.select("level_uid", "level_no"), "level_uid").select("node_id", "level_no", (F.col("level_no").cast("long") * 1_000_000 + F.col("node_cluster")).alias("cluster"))
    up = a.select("node_id", (F.col("level_no") + 1).alias("level_no"), F.col("cluster").alias("up"))
    k = a.join(up, ["node_id", "level_no"], "left").groupBy("cluster", "level_no", "up").agg(F.count("*").alias("n"))
    best = k.groupBy("cluster", "level_no").agg(F.min(F.when(F.col("up").isNotNull(), F.struct((-F.col("n")).alias("m"), "up")))["up"].alias("up"))
    root = spark.createDataFrame([(999999999, -1, 0.5)], "cluster long, parent long, birth double")
    tree = best.select("cluster", F.coalesce("up", F.lit(999999999)).alias("parent"), (F.col("level_no") + 1.0).cast("double").alias("birth")).unionByName(root)
    leaves = spark.createDataFrame([(5.0,)], "level double")
    return multilevel.discover_layers(cut(tree), leaves).select("count", F.round("level", 6).alias("level"), F.round("persistence", 6).alias("persistence"))


@query("e16_jaccard_classes", f"""WITH {LEVELS}, {_AB}, s AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM ab WHERE a >= 0 AND b >= 0), j AS (SELECT a, max(n / (na + nb - n)) AS j FROM s GROUP BY 1)
    SELECT CASE WHEN j >= 0.85 THEN 'stable' WHEN j >= 0.6 THEN 'doubtful' ELSE 'unstable' END AS class, count(*) AS clusters, round(avg(j), 6) AS mean FROM j GROUP BY 1""")
def jaccard_classes(spark, d):
    from pyspark.sql import Window

    t = _compared(spark, d).table.filter("a >= 0 and b >= 0")
    t = t.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    j = t.groupBy("a").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))
    return j.groupBy(metrics.jaccard_class(F.col("j")).alias("class")).agg(F.count("*").alias("clusters"), F.round(F.avg("j"), 6).alias("mean"))


@query("n3_adjusted_information", f"""WITH {LEVELS}, {_SCORED}, pr AS (SELECT ma.first_level, ma.second_level, ma.n::BIGINT AS x, mb.n::BIGINT AS y, count(*) AS times FROM ma JOIN mb USING (first_level, second_level) GROUP BY ALL),
    ks AS (SELECT pr.*, s.n::BIGINT AS n, unnest(range(greatest(1, x + y - s.n::BIGINT), least(x, y) + 1)) AS k FROM pr JOIN s USING (first_level, second_level)),
    ex AS (SELECT first_level, second_level, sum(times * (k / n) * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS expected FROM ks GROUP BY ALL)
    SELECT first_level, second_level, round((mi - expected) / (greatest(ha, hb) - expected), 5) AS ami FROM s JOIN ex USING (first_level, second_level)""")
def adjusted_information(spark, d):
    t = _level_tables(Domain(spark, d)).withColumn("pair", F.concat_ws("-", "first_level", "second_level"))
    part = F.split("pair", "-")
    return metrics.ami(t, "pair").select(part[0].cast("int").alias("first_level"), part[1].cast("int").alias("second_level"), F.round("ami", 5).alias("ami"))


@query("a7_subset", f"WITH {NODE_EDGES}, top AS (SELECT dst AS node_id, row_number() OVER (ORDER BY count(*) DESC, dst) - 1 AS position FROM ne GROUP BY 1 QUALIFY position < 60) SELECT paper_id, position AS node_id FROM top JOIN nodes1 USING (node_id)")
def subset(spark, d):
    """The most cited papers as a subset of their own, numbered anew."""
    dom = Domain(spark, d)
    from pyspark.sql import Window

    n = dom.nodes.select("node_id", "paper_id")
    top = dom.node_edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "node_id").limit(60)
    wanted = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("k"), "node_id")) - 1).join(n, "node_id").select("paper_id", "position")  # sixty rows
    return corpus.subset(n.select("paper_id"), cut(wanted))


@query("i_junk", f"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS term FROM documents WHERE text IS NOT NULL)
    SELECT count(*) FILTER (WHERE junk) AS junk, count(*) FILTER (WHERE NOT junk) AS words, min(term) FILTER (WHERE junk) AS first_junk FROM (SELECT term, regexp_matches(term, '^[0-9]+$') OR term IN ({", ".join(f"'{w}'" for w in sorted(set(FOREIGN_WORDS)))}) AS junk FROM w)""")
def junk_words(spark, d):
    w = Domain(spark, d).raw("documents").filter("text is not null").select(F.explode(tokens(F.col("text"))).alias("term")).distinct().withColumn("junk", is_junk(F.col("term")))
    return w.agg(F.count_if("junk").alias("junk"), F.count_if(~F.col("junk")).alias("words"), F.min(F.when(F.col("junk"), F.col("term"))).alias("first_junk"))


def _channel_sql(scale: str, c: int, v: str) -> str:
    stops = SCALES[scale]
    parts = " ".join(f"WHEN {v} <= {b[0]} THEN {a[c]} + ({v} - {a[0]}) / ({b[0]} - {a[0]}) * ({b[c]} - {a[c]})" for a, b in zip(stops, stops[1:], strict=False))
    return f"floor((CASE {parts} ELSE {stops[-1][c]} END)::DOUBLE + 0.5)::INT"


@query("i_colours", f"WITH {NODE_EDGES}, deg AS (SELECT dst, count(*) AS k FROM ne GROUP BY 1), m AS (SELECT max(k) AS most FROM deg), v AS (SELECT dst, ln(1 + k) / ln(1 + most) AS v FROM deg, m) SELECT dst AS node_id, printf('#%02x%02x%02x', {_channel_sql('in_degree', 1, 'v')}, {_channel_sql('in_degree', 2, 'v')}, {_channel_sql('in_degree', 3, 'v')}) AS colour FROM v")
def colours(spark, d):
    deg = Domain(spark, d).node_edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("k"))
    v = deg.crossJoin(F.broadcast(deg.agg(F.max("k").alias("most")))).select("node_id", log_scale(F.col("k"), F.col("most")).alias("v"))  # one row
    return v.select("node_id", colour(F.col("v"), "in_degree").alias("colour"))


@query("b7_project_round_trip", "SELECT level_uid, level_no, scope, method, min_members FROM level_info")
def project_round_trip(spark, d):
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/projects/{uuid.uuid4().hex}"
    export.save_project(spark, path, {"levels": Domain(spark, d).levels}, {})
    return export.load_project(spark, path)[0]["levels"].select("level_uid", "level_no", "scope", "method", "min_members")


@query("t_scoring_prep", f"WITH {ASSIGN} SELECT level_uid, node_cluster, count(*) AS size, '(unlabelled)' AS label, NULL::INT AS score FROM assign WHERE node_cluster >= 0 GROUP BY ALL")
def scoring_prep(spark, d):
    return lanes.scoring_prep({"assign": Domain(spark, d).assign})


@query("c13_assignment_contract", f"WITH {ASSIGN} SELECT level_uid, count(*) - count(DISTINCT node_id) AS repeated, greatest(max(node_cluster) + 1 - count(DISTINCT node_cluster) FILTER (WHERE node_cluster >= 0), 0)::BIGINT AS gaps FROM assign GROUP BY 1")
def assignment_contract(spark, d):
    return validation.assignment_violations(Domain(spark, d).assign)


@query("c13_layout_contract", f"WITH {POSITIONS} SELECT count(*) - count(DISTINCT node_id) AS repeated, count(*) FILTER (WHERE NOT isfinite(x) OR NOT isfinite(y) OR NOT isfinite(z)) AS not_finite FROM pos")
def layout_contract(spark, d):
    return validation.layout_violations(Domain(spark, d).positions)


@query("j1_identity", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, len(embedding) AS dims FROM embeddings")
def identity(spark, d):
    r = dimred.reduce("identity", Domain(spark, d).raw("embeddings"), "vec_id", "embedding")
    return r.select("vec_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("vec").cast("long").alias("dims"))


@query("a13_stage_input", f"WITH {POSITIONS} SELECT 'base_pos' AS stage, count(*) AS rows, round(sum(x + y + z), 2) AS total FROM pos")
def stage_input(spark, d):
    name, df = corpus.stage_input(None, Domain(spark, d).positions)
    return df.agg(F.lit(name).alias("stage"), F.count("*").alias("rows"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)), 2).alias("total")).select("stage", "rows", "total")




@query("h4_tastes_of_clusters", f"""WITH {NODE_EDGES}, {LEVELS}, f AS (SELECT node_id, node_cluster FROM leveled WHERE level_no = 3 AND node_cluster >= 0), c AS (SELECT node_id, node_cluster FROM leveled WHERE level_no = 2 AND node_cluster >= 0),
    m AS (SELECT DISTINCT f.node_cluster AS nb, c.node_cluster FROM f JOIN c USING (node_id)), t AS (SELECT DISTINCT x.node_cluster AS nb, y.node_cluster AS cites FROM ne JOIN f x ON x.node_id = src JOIN f y ON y.node_id = dst) SELECT DISTINCT m.node_cluster, t.cites FROM m JOIN t USING (nb)""")
def tastes_of_clusters(spark, d):
    """What each cluster's finer clusters cite, taken together."""
    dom = Domain(spark, d)
    f, c = dom.level(3).filter("node_cluster >= 0"), dom.level(2).filter("node_cluster >= 0")
    members = f.select("node_id", F.col("node_cluster").alias("neighbourhood")).join(c, "node_id")
    x, y = (f.select(F.col("node_id").alias(e), F.col("node_cluster").alias(n)) for e, n in (("src", "neighbourhood"), ("dst", "cites")))
    return taste.of_clusters(dom.node_edges.join(x, "src").join(y, "dst").select("neighbourhood", "cites").distinct(), members)


@query("q1_imported_links", f"WITH {NODE_EDGES} SELECT src, dst FROM ne")
def imported_links(spark, d):
    dom = Domain(spark, d)
    raw = dom.raw("citations")
    n = dom.nodes
    a, b = (n.select(F.col("paper_id").alias(p), F.col("node_id").alias(e)) for p, e in (("citing_id", "src"), ("cited_id", "dst")))
    return taste.citations("imported", n, imported=raw.join(a, "citing_id").join(b, "cited_id").select("src", "dst"))
