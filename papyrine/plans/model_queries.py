"""Queries on sources, vectors, clusterings, labels, layouts and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions.text import STOP_WORDS, phrases, tokens
from papyrine.operators import analytics, clustering, dimred, export, graph, hdbscan, labels, layout, metrics, multilevel, search, taste, vectors
from papyrine.operators.numbering import running_sum
from papyrine.plans.registry import ASSIGN, EDGES, LEVELS, NODE_EDGES, NODES, POSITIONS, query
from papyrine.plans.tables import SCORES, Domain
from papyrine.session import cut
from papyrine.sources import corpus, mixture, registry

#: White space in the SQL's regular expressions, and a text without it at either end.
_WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_WS}|{_WS}$', '', 'g')"


# --- sources -----------------------------------------------------------------------------------------------------


@query("a1_sources", "SELECT * FROM (VALUES ('matrix', 'NPY matrix'), ('subset', 'NPY matrix with its papers, years and links'), ('tables', 'Parquet tables of nodes and citations'), ('toy', 'Gaussian mixture')) AS v(name, label)")
def sources(spark, d):
    return spark.createDataFrame([(s.name, s.label) for s in registry.SOURCES.values()], "name string, label string")


@query("a2_mixture")
def toy_mixture(spark, d):
    nodes, _ = mixture.mixture(spark)
    return nodes.select("node_id", "origin_id", F.round("t", 6).alias("t"), *(F.round(F.get("base_pos", F.lit(i)), 6).alias(c) for i, c in enumerate("xyz")))


@query("a5_normalised_time", f"WITH {NODES}, r AS (SELECT min(year) AS lo, max(year) AS hi FROM nodes1) SELECT node_id, round(CASE WHEN year IS NULL THEN 1.0 ELSE 1 - (year - lo) / (hi - lo) END, 6) AS t FROM nodes1, r")
def normalised_time(spark, d):
    return corpus.normalised_time(Domain(spark, d).nodes).select("node_id", F.round("t", 6).alias("t"))


@query("a6_drift", f"WITH {NODES}, c AS (SELECT DISTINCT paper_id FROM cart) SELECT coalesce(n.paper_id, c.paper_id) AS paper_id, CASE WHEN n.paper_id IS NULL THEN 'table' ELSE 'index' END AS side FROM nodes1 n FULL JOIN c ON n.paper_id = c.paper_id WHERE n.paper_id IS NULL OR c.paper_id IS NULL")
def drift(spark, d):
    dom = Domain(spark, d)
    return corpus.drift(dom.nodes, dom.cart.select("paper_id").distinct())


@query("a10_records", f"""SELECT row_id, concat_ws('. ', CASE WHEN {_strip('title')} <> '' THEN {_strip('title')} END, CASE WHEN {_strip('venue')} <> '' THEN {_strip('venue')} END) AS text,
    len(list_filter(string_split(coalesce(authors, ''), ';'), lambda a: {_strip('a')} <> '')) AS authors FROM cart""")
def records(spark, d):
    return Domain(spark, d).cart.select("row_id", corpus.record_text(F.col("title"), F.col("venue")).alias("text"), F.size(corpus.author_list(F.col("authors"))).cast("long").alias("authors"))


# --- exports -----------------------------------------------------------------------------------------------------

_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in export.RIS_TYPES.items())
_FLAT = _strip(r"regexp_replace({0}::VARCHAR, '\s*\r?\n\s*', ' ', 'g')").replace("x{", "x{{").replace("}", "}}").replace("{0}}", "{0}")


def _ris_line(tag: str, col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL AND {col}::VARCHAR <> '' THEN '{tag}  - ' || {_FLAT.format(col)} END"


_RIS_SQL = f"""concat_ws(chr(10), 'TY  - ' || CASE lower(pub_type) {_TYPES} ELSE 'GEN' END,
    nullif(array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: {_strip('a')}), lambda a: a <> ''), lambda a: 'AU  - ' || {_FLAT.format('a')}), chr(10)), ''),
    {_ris_line('TI', 'title')}, {_ris_line('PY', 'year')}, {_ris_line('JO', 'venue')}, {_ris_line('DO', 'doi')}, 'ER  - ')"""


def _ris(cart):
    return export.ris_record(F.col("authors"), F.col("title"), F.col("year"), F.col("venue"), F.col("doi"), F.col("pub_type"))


@query("b1_ris_records", f"SELECT row_id, {_RIS_SQL} AS record FROM cart")
def ris_records(spark, d):
    c = Domain(spark, d).cart
    return c.select("row_id", _ris(c).alias("record"))


@query("b3_selection_records", f"WITH {LEVELS}, {SCORES}, sel AS (SELECT a.node_id FROM leveled a JOIN scores s USING (level_uid, node_cluster) WHERE a.level_no = 2 AND s.score >= 4), r AS (SELECT DISTINCT node_id FROM cart WHERE node_id IS NOT NULL AND title IS NOT NULL) SELECT count(r.node_id) AS count, count(*) FILTER (WHERE r.node_id IS NULL) AS missing FROM sel LEFT JOIN r ON sel.node_id = r.node_id")
def selection_records(spark, d):
    dom = Domain(spark, d)
    s = dom.scores.filter("level_no = 2 and score >= 4")
    chosen = dom.assign.join(s, ["level_uid", "node_cluster"], "left_semi").select("node_id")
    c = dom.cart.filter("node_id is not null and title is not null")
    one = c.groupBy("node_id").agg(F.min(F.struct("row_id", _ris(c).alias("record")))["record"].alias("record"))
    return export.selection_records(chosen, one)[1]


@query("b5_cart_json_lines", """SELECT row_id, '{"id":' || paper_id || ',"source":"' || replace(replace(source, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}' AS json FROM cart WHERE source IS NOT NULL""")
def cart_json_lines(spark, d):
    return Domain(spark, d).cart.filter("source is not null").select("row_id", F.to_json(F.struct(F.col("paper_id").alias("id"), "source")).alias("json"))


# --- vectors -----------------------------------------------------------------------------------------------------

_PAIRS = """pair AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 9) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM pair)"""


def _embeddings(spark, d):
    return Domain(spark, d).raw("embeddings")


@query("f1_nearest_neighbours", f"WITH {_PAIRS} SELECT src, dst, rank FROM knn WHERE rank <= 8")
def nearest_neighbours(spark, d):
    return vectors.knn(_embeddings(spark, d), "vec_id", "embedding", 8).select("src", "dst", "rank")


@query("f2_core_distance", f"WITH {_PAIRS} SELECT src AS vec_id, round(sqrt(d2), 6) AS core FROM knn WHERE rank = 5")
def core_distance(spark, d):
    return vectors.knn(_embeddings(spark, d), "vec_id", "embedding", 5).filter("rank = 5").select(F.col("src").alias("vec_id"), F.round(F.sqrt("d2"), 6).alias("core"))


@query("d7_mutual_neighbours", f"WITH {_PAIRS} SELECT a.src, a.dst FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= 8 AND b.rank <= 8")
def mutual_neighbours(spark, d):
    e = vectors.knn(_embeddings(spark, d), "vec_id", "embedding", 8).select("src", "dst")
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


@query("g5_closest_pairs", f"WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM embeddings) SELECT src AS i, dst AS j FROM (SELECT *, row_number() OVER (ORDER BY d2, src, dst) AS rn FROM pair WHERE src < dst), n WHERE rn <= round(0.01 * n * (n - 1) / 2)")
def closest_pairs(spark, d):
    return vectors.closest_pairs(_embeddings(spark, d), "vec_id", "embedding", 0.01).select("i", "j")


_CLUSTERS = """comp AS (SELECT id, min(other) AS c FROM (SELECT a AS id, b AS other FROM reach UNION ALL SELECT vec_id, vec_id FROM embeddings) GROUP BY id)
    SELECT id AS node_id, dense_rank() OVER (ORDER BY c) - 1 AS node_cluster FROM comp"""


@query("l2_mutual_knn", f"WITH RECURSIVE {_PAIRS}, link AS (SELECT a.src AS a, a.dst AS b FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.rank <= 3 AND b.rank <= 3), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), {_CLUSTERS}")
def mutual_knn(spark, d):
    return clustering.mutual_knn(_embeddings(spark, d), "vec_id", "embedding", 3)


@query("l3_knn_components", f"WITH RECURSIVE {_PAIRS}, fwd AS (SELECT src, dst FROM knn WHERE rank <= 1 AND dst > src), link AS (SELECT src AS a, dst AS b FROM fwd UNION SELECT dst, src FROM fwd), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), {_CLUSTERS}")
def knn_components(spark, d):
    return clustering.knn_components(_embeddings(spark, d), "vec_id", "embedding", 1)


@query("l3_knn_components_either", f"WITH RECURSIVE {_PAIRS}, fwd AS (SELECT src, dst FROM knn WHERE rank <= 1), link AS (SELECT src AS a, dst AS b FROM fwd UNION SELECT dst, src FROM fwd), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), {_CLUSTERS}")
def knn_components_either(spark, d):
    return clustering.knn_components(_embeddings(spark, d), "vec_id", "embedding", 1, either=True)


@query("l4_hdbscan")
def hdbscan_levels(spark, d):
    return hdbscan.cluster(_embeddings(spark, d), "vec_id", "embedding", min_size=15, min_samples=5)


@query("l12_hdbscan_singletons")
def hdbscan_singletons(spark, d):
    return hdbscan.cluster(_embeddings(spark, d), "vec_id", "embedding", min_size=15, min_samples=5, noise="singletons", method="leaf")


@query("l14_condensed_tree")
def condensed_tree(spark, d):
    t, _ = hdbscan.tree_tables(_embeddings(spark, d), "vec_id", "embedding", 10)
    return t.select("cluster", "parent", F.round("birth", 6).alias("birth"), F.round("stability", 6).alias("stability"), "size")


@query("l15_cascade")
def cascade(spark, d):
    return clustering.cascade(_embeddings(spark, d), "vec_id", "embedding", [{"scope": "global", "min_size": 30}, {"scope": "within-parent", "min_size": 8}])


@query("l19_kmeans")
def kmeans(spark, d):
    return vectors.kmeans(_embeddings(spark, d), "vec_id", "embedding", 10)


@query("m2_layers")
def discovered_layers(spark, d):
    t, leaves = hdbscan.tree_tables(_embeddings(spark, d), "vec_id", "embedding", 5)
    return multilevel.discover_layers(cut(t), cut(leaves))


@query("m8_size_sweep")
def size_sweep(spark, d):
    return clustering.size_sweep(_embeddings(spark, d), "vec_id", "embedding")


_STEPS = """ks AS (SELECT count(*) AS k FROM leveled WHERE level_no = 2 AND node_cluster >= 0 GROUP BY node_cluster), steps AS (SELECT s AS size, (SELECT count(*) FROM ks WHERE k >= s) AS count FROM (SELECT unnest(range(2, (SELECT max(k) + 1 FROM ks))) AS s))"""


def _steps(spark, d):
    """The number of clusters of each least size from 2 to the largest: sizes of the clusters summed up from above, every size in between once."""
    k = Domain(spark, d).level(2).filter("node_cluster >= 0").groupBy("node_cluster").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("m"))
    at_least = running_sum(k, "k", F.col("m"), "count", True).select("k", "count")
    below = running_sum(k.select("k"), "k", F.lit(1).cast("long"), "place").select("k", "place")  # sizes above the one before
    before = below.select(F.col("k").alias("prior"), (F.col("place") + 1).alias("place"))
    spans = below.join(before, "place", "left").join(at_least, "k")
    return spans.filter("k >= 2").select(F.explode(F.sequence(F.greatest(F.lit(2).cast("long"), F.coalesce(F.col("prior") + 1, F.lit(2))), F.col("k"))).alias("size"), "count")


@query("m9_plateaus", f"""WITH {LEVELS}, {_STEPS}, m AS (SELECT *, CASE WHEN count = lag(count) OVER (ORDER BY size) THEN 0 ELSE 1 END AS new FROM steps), r AS (SELECT *, sum(new) OVER (ORDER BY size) AS run FROM m),
    e AS (SELECT count, run, count(*) AS width, list_sort(list(size)) AS sizes FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY count ORDER BY width DESC, run) AS rk FROM e WHERE count >= 2) SELECT count, sizes[(len(sizes) - 1) // 2 + 1] AS size, width FROM b WHERE rk = 1""")
def plateaus(spark, d):
    return analytics.plateaus(_steps(spark, d))


@query("m11_ladder", f"""WITH {LEVELS}, {_STEPS}, c AS (SELECT DISTINCT count FROM steps WHERE count >= 2), p AS (SELECT count FROM c WHERE count IN (3, 5, 8, 13, 99)) SELECT 'ML-L' || (row_number() OVER (ORDER BY count) - 1) AS uid, count FROM p""")
def layer_ladder(spark, d):
    return multilevel.ladder(analytics.plateaus(_steps(spark, d)), [8, 3, 99, 3, 5, 13]).select("uid", "count")


@query("n6_bootstrap")
def bootstrap(spark, d):
    e = _embeddings(spark, d)
    ref = cut(hdbscan.cluster(e, "vec_id", "embedding", min_size=15))
    r = clustering.bootstrap(e, "vec_id", "embedding", ref, min_size=8)
    return r.select("cluster", "members", F.round("jaccard", 6).alias("jaccard"), "rounds", "class")


@query("n5_bayes_ari")
def bayes_ari(spark, d):
    nodes, origins = mixture.mixture(spark)
    best = clustering.bayes_labels(nodes, origins)
    t = metrics.contingency(nodes.select("node_id", F.col("origin_id").alias("a")), best.select("node_id", F.col("origin").alias("b")))
    return metrics.scores(t).select("n", F.round("ari", 6).alias("ari"))


@query("j3_pca")
def pca(spark, d):
    out, _ = vectors.pca(_embeddings(spark, d), "vec_id", "embedding", 3)
    return out.select("vec_id", *(F.round(F.get("vec", F.lit(i)), 5).alias(f"c{i}") for i in range(3)))


@query("j4_umap")
def umap(spark, d):
    return dimred.umap(_embeddings(spark, d), "vec_id", "embedding", 2).select("vec_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))


@query("o1_latin_hypercube")
def latin_hypercube(spark, d):
    rows = search.latin_hypercube(clustering.ALGORITHMS["hdbscan"], 12, 42)
    return spark.createDataFrame([(i, r["min_size"], r["min_samples"], float(r["epsilon"])) for i, r in enumerate(rows)], "setting int, min_size int, min_samples int, epsilon double")


@query("o2_grid_sweep")
def grid_sweep(spark, d):
    e = _embeddings(spark, d)
    settings = search.grid({"min_size": [8, 15, 30], "min_samples": [3, 5]})
    return search.sweep(e, "vec_id", "embedding", settings, e.select(F.col("vec_id").alias("node_id"), "label")).withColumn("ari", F.round("ari", 6))


@query("o3_target_range")
def target_range(spark, d):
    schema = {"min_size": {"kind": "int", "min": 3, "max": 40}}
    return search.target_range(_embeddings(spark, d), "vec_id", "embedding", schema, 5, 15)


@query("o6_dimension_sweep")
def dimension_sweep(spark, d):
    r = search.dimension_sweep(_embeddings(spark, d), "vec_id", "embedding", [5, 10, 20], [1, 2], 10)
    return r.select("d1", "d2", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "clusters_1", "clusters_2")


# --- graphs ------------------------------------------------------------------------------------------------------


@query("k1_components")
def components(spark, d):
    dom = Domain(spark, d)
    own = dom.nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return graph.connected_components(dom.node_edges.unionByName(own))


@query("k3_hops", f"""WITH {NODE_EDGES}, bothways AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), s AS (SELECT dst AS id FROM ne GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1),
    h1 AS (SELECT DISTINCT b AS id FROM bothways JOIN s ON a = s.id), h2 AS (SELECT DISTINCT b AS id FROM bothways JOIN h1 ON a = h1.id), h3 AS (SELECT DISTINCT b AS id FROM bothways JOIN h2 ON a = h2.id),
    u AS (SELECT id, 0 AS hops FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) SELECT id, min(hops) AS hops FROM u GROUP BY id""")
def hops(spark, d):
    e = cut(Domain(spark, d).node_edges)
    start = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "id").limit(1).select("id")
    return graph.hops(e, start, 3)


@query("k5_spanning_tree_weight")
def spanning_tree_weight(spark, d):
    e = vectors.knn(_embeddings(spark, d), "vec_id", "embedding", 10)
    t = graph.minimum_spanning_forest(e.select("src", "dst", F.sqrt("d2").alias("w")))
    return t.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("weight"))


@query("k10_triangles", f"""WITH {NODE_EDGES}, {LEVELS}, c AS (SELECT DISTINCT x.node_cluster AS a, y.node_cluster AS b FROM ne JOIN leveled x ON x.node_id = src AND x.level_no = 2 AND x.node_cluster >= 0 JOIN leveled y ON y.node_id = dst AND y.level_no = 2 AND y.node_cluster >= 0 WHERE x.node_cluster <> y.node_cluster)
    SELECT x.b AS a, y.b AS b, count(*) AS n FROM c x JOIN c y ON x.a = y.a AND x.b < y.b GROUP BY ALL""")
def triangles(spark, d):
    dom = Domain(spark, d)
    a, b = (dom.level(2).filter("node_cluster >= 0").select(F.col("node_id").alias(s), F.col("node_cluster").alias(c)) for s, c in (("src", "a"), ("dst", "b")))
    c = dom.node_edges.join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct()
    return graph.common_sources(c)


@query("k9_rewired_ghosts")
def rewired(spark, d):
    from papyrine.operators.ghosts import rewire

    dom = Domain(spark, d)
    return rewire(dom.nodes, dom.node_edges)


_START = """p AS (SELECT node_id, base_pos[1] AS x, base_pos[2] AS y, base_pos[3] AS z FROM nodes1 WHERE base_pos IS NOT NULL), g AS (SELECT node_id FROM nodes1 WHERE is_ghost),
    m AS (SELECT node_id FROM p UNION SELECT node_id FROM g), bw0 AS (SELECT src AS a, dst AS b FROM ne UNION SELECT dst, src FROM ne), bw AS (SELECT e.a, e.b FROM bw0 e SEMI JOIN m m1 ON m1.node_id = e.a SEMI JOIN m m2 ON m2.node_id = e.b),
    dg AS (SELECT a, count(*) AS k FROM bw GROUP BY 1), s0 AS (SELECT * FROM p UNION ALL SELECT e.a, avg(x), avg(y), avg(z) FROM bw e JOIN g ON g.node_id = e.a JOIN p ON p.node_id = e.b GROUP BY 1)"""


def _step(i: int) -> str:
    mean = f"n{i} AS (SELECT e.a AS node_id, sum(x) / max(k) AS x, sum(y) / max(k) AS y, sum(z) / max(k) AS z FROM bw e JOIN dg ON dg.a = e.a JOIN s{i - 1} s ON s.node_id = e.b GROUP BY 1)"
    new = ", ".join(f"CASE WHEN p.{c} IS NULL THEN n.{c} ELSE 0.5 * p.{c} + 0.5 * coalesce(n.{c}, 0) END AS {c}" for c in "xyz")
    return f"{mean}, s{i} AS (SELECT coalesce(p.node_id, n.node_id) AS node_id, {new} FROM p FULL JOIN n{i} n ON n.node_id = p.node_id)"


def _diffused(spark, d, iterations: int = 3):
    dom = Domain(spark, d)
    n = dom.nodes
    return dimred.diffuse(n.filter("base_pos is not null").select("node_id", F.col("base_pos").alias("vec")), dom.node_edges, 0.5, iterations, ghosts=n.filter("is_ghost").select("node_id"))


@query("j5_diffusion", f"WITH {NODE_EDGES}, {_START}, {_step(1)}, {_step(2)}, {_step(3)} SELECT node_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM s3")
def diffusion(spark, d):
    return _wide(_diffused(spark, d)).select("node_id", *(F.round(c, 3).alias(c) for c in "xyz"))


@query("j6_viewer_scale", f"WITH {POSITIONS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM pos) SELECT node_id, round((x - mx) * 90 / r, 4) AS x, round((y - my) * 90 / r, 4) AS y, round((z - mz) * 90 / r, 4) AS z FROM pos, m")
def viewer_scale(spark, d):
    return dimred.viewer_scale(Domain(spark, d).positions).select("node_id", *(F.round(c, 4).alias(c) for c in "xyz"))


@query("r3_blend", f"WITH {POSITIONS}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS r FROM pos) SELECT node_id, " + ", ".join(f"round(0.7 * (0.6 * {c} + 0.4 * ({c} - m{c}) * 90 / r) + 0.3 * -{c}, 4) AS {c}" for c in "xyz") + " FROM pos, m")
def blend(spark, d):
    p = Domain(spark, d).positions
    mirrored = p.select("node_id", *((-F.col(c)).alias(c) for c in "xyz"))
    return layout.blend(p, dimred.viewer_scale(p), mirrored, 0.4, 0.3).select("node_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def _wide(vectors_):
    return vectors_.select("node_id", *(F.col("vec")[i].alias(c) for i, c in enumerate("xyz")))


@query("n10_displacement")
def displacement(spark, d):
    after = cut(_wide(_diffused(spark, d)))
    return layout.displacement(Domain(spark, d).positions, after).select("node_id", F.round("moved", 4).alias("moved"))


@query("g3_top_displacement")
def top_displacement(spark, d):
    return displacement(spark, d).orderBy(F.desc("moved"), "node_id").limit(100)


@query("r1_align_components")
def align_components(spark, d):
    dom = Domain(spark, d)
    return layout.align_by_component(dom.positions, cut(_wide(_diffused(spark, d))), dom.node_edges)[1].select(F.round("correlation", 5).alias("correlation"))


@query("r2_align_global")
def align_global(spark, d):
    moved, _ = layout.align(Domain(spark, d).positions, cut(_wide(_diffused(spark, d))))
    return moved.select("node_id", *(F.round(c, 4).alias(c) for c in "xyz"))


@query("n13_contamination")
def contamination(spark, d):
    """How far diffusion with ghosts moves the other nodes against diffusion without them, and whether ranks of distances to the centre keep."""
    dom = Domain(spark, d)
    flat = dom.nodes.filter("base_pos is not null").select("node_id", F.col("base_pos").alias("vec"))
    a, b = cut(_wide(_diffused(spark, d))), cut(_wide(dimred.diffuse(flat, dom.node_edges, 0.5, 3)))
    j = a.select("node_id", *(F.col(c).alias(c + "1") for c in "xyz")).join(b, "node_id")
    far = lambda s: F.sqrt(sum(F.col(c + s) ** 2 for c in "xyz"))
    moved = F.sqrt(sum((F.col(c + "1") - F.col(c)) ** 2 for c in "xyz"))
    return j.agg(F.count("*").alias("nodes"), F.round(F.avg(moved), 4).alias("mean_moved"), F.round(F.corr(far("1"), far("")), 5).alias("correlation"))


@query("q2_neighbourhoods")
def neighbourhoods(spark, d):
    dom = Domain(spark, d)
    return taste.neighbourhoods(dom.positions, dom.level(3))


@query("q4_drawn_links")
def drawn_links(spark, d):
    nodes, _ = mixture.mixture(spark)  # links are drawn for the mixture only; the tables have theirs
    pos = nodes.select("node_id", *(F.get("base_pos", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    return taste.citations("taste-network", nodes, nodes.select("node_id", F.col("origin_id").alias("node_cluster")), pos)


@query("r4_layout_forces")
def layout_forces(spark, d):
    dom = Domain(spark, d)
    return layout.layout("forces", dom.nodes, dom.node_edges)


@query("r5_layout_mds")
def layout_mds(spark, d):
    dom = Domain(spark, d)
    return layout.layout("mds", dom.nodes, dom.node_edges)


@query("r6_layout_graph")
def layout_graph(spark, d):
    dom = Domain(spark, d)
    return layout.layout("umap-graph", dom.nodes, dom.node_edges)


# --- labels ------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_TERMS = f"""word AS (SELECT source AS cluster, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS term FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    cnt AS (SELECT cluster, term, count(*) AS count FROM word GROUP BY ALL), tot AS (SELECT cluster, sum(count) AS total FROM cnt GROUP BY 1), df AS (SELECT term, count(*) AS df FROM cnt GROUP BY 1), nc AS (SELECT count(DISTINCT source) AS n FROM documents),
    sc AS (SELECT cluster, term, count, df, round(count / total * ln(1 + n / (1 + df)), 9) AS score FROM cnt JOIN df USING (term) JOIN tot USING (cluster), nc)"""


def _texts(spark, d):
    return Domain(spark, d).raw("documents").select(F.col("source").alias("cluster"), "text")


@query("label_terms", f"WITH {_TERMS} SELECT cluster, rank, term FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM sc) WHERE rank <= 4")
def label_terms(spark, d):
    return labels.top_terms(labels.term_scores(_texts(spark, d))).select("cluster", "rank", "term")


@query("label_document_frequency", f"WITH {_TERMS} SELECT df, count(*) AS terms FROM df GROUP BY 1")
def label_document_frequency(spark, d):
    return labels.term_scores(_texts(spark, d)).select("term", "df").distinct().groupBy("df").agg(F.count("*").alias("terms"))


@query("label_medoids", """WITH l AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM l GROUP BY ALL),
    s AS (SELECT label, vec_id, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 9) AS cosine FROM l JOIN c USING (label, i) GROUP BY ALL) SELECT label, vec_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rn FROM s) WHERE rn = 1""")
def label_medoids(spark, d):
    return vectors.medoids(_embeddings(spark, d), "vec_id", "label", "embedding").select("label", "representative")


@query("label_keyphrases")
def label_keyphrases(spark, d):
    return labels.keyphrases(_texts(spark, d))


@query("label_bands")
def label_bands(spark, d):
    return labels.banded(_texts(spark, d))


@query("label_combined")
def label_combined(spark, d):
    t = _texts(spark, d)
    return labels.combined({"keybert": labels.keyphrases(t), "cTfidf": labels.top_terms(labels.term_scores(t))}, t.filter("cluster is not null"))


@query("i_phrases", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l) AS words, CASE WHEN len(l) > 0 THEN 2 * len(l) - 1 ELSE 0 END AS phrases FROM w""")
def text_phrases(spark, d):
    t = Domain(spark, d).raw("documents").filter("text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("words"), F.size(phrases(F.col("w"), 2)).cast("long").alias("phrases"))


@query("i_shares", f"""WITH {LEVELS}, c AS (SELECT f.node_cluster AS fine, c.node_cluster AS coarse, count(*) AS n FROM leveled f JOIN leveled c ON f.node_id = c.node_id AND f.level_no = 3 AND c.level_no = 2 WHERE f.node_cluster >= 0 GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY fine) AS fr FROM c) SELECT fine, string_agg(coarse || ':' || floor(fr * 100 + 0.5)::INT || '%', ' ' ORDER BY n DESC, coarse) AS shares FROM s GROUP BY 1""")
def share_lists(spark, d):
    dom = Domain(spark, d)
    s = analytics.level_pairs(dom.assign, dom.levels, adjacent=True).filter("fine_level = 3")
    return analytics.bridges(s).select("fine", "shares")


@query("i_log_scale", f"WITH {NODE_EDGES}, deg AS (SELECT dst, count(*) AS k FROM ne GROUP BY 1), m AS (SELECT max(k) AS most FROM deg) SELECT dst AS node_id, round(ln(1 + k) / ln(1 + most), 6) AS scaled FROM deg, m")
def log_scale(spark, d):
    from papyrine.functions.colours import log_scale as scale

    deg = Domain(spark, d).node_edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("k"))
    return deg.crossJoin(F.broadcast(deg.agg(F.max("k").alias("most")))).select("node_id", F.round(scale(F.col("k"), F.col("most")), 6).alias("scaled"))


@query("h5_token_overlap", "SELECT x.level_uid AS a, y.level_uid AS b, round(len(list_intersect(string_split(x.level_uid, '-'), string_split(y.level_uid, '-'))) / len(list_distinct(list_concat(string_split(x.level_uid, '-'), string_split(y.level_uid, '-')))), 6) AS overlap FROM level_info x JOIN level_info y ON x.level_no < y.level_no")
def token_overlap(spark, d):
    from papyrine.functions.text import token_overlap as overlap

    lv = Domain(spark, d).levels  # four rows
    x, y = lv.select(F.col("level_uid").alias("a"), F.col("level_no").alias("na")), lv.select(F.col("level_uid").alias("b"), F.col("level_no").alias("nb"))
    words = lambda c: F.translate(F.col(c), "-", " ")
    return x.join(y, F.col("na") < F.col("nb")).select("a", "b", F.round(overlap(words("a"), words("b")), 6).alias("overlap"))


@query("h6_parameter_grid", "SELECT min_size::INT AS min_size, min_samples::INT AS min_samples FROM unnest([5, 10, 20]) t(min_size), unnest([1, 5]) u(min_samples)")
def parameter_grid(spark, d):
    rows = search.grid({"min_size": [5, 10, 20], "min_samples": [1, 5]})
    return spark.createDataFrame([(r["min_size"], r["min_samples"]) for r in rows], "min_size int, min_samples int")


@query("t_step_table", "SELECT * FROM (VALUES (1, 'source', 'source'), (2, 'clustering', 'clustering')) v(id, kind, label)")
def step_table(spark, d):
    from papyrine.plans.workflow import Tree

    t = Tree()
    s = t.create("source")
    t.create("clustering", parent=s.id)
    return t.table(spark).select("id", "kind", "label")
