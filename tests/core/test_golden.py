"""Small inputs with results computed by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import analytics, clustering, export, hdbscan, labels, layout, metrics, multilevel, search, selection, vectors
from papyrine.operators.dimred import diffuse
from papyrine.operators.graph import connected_components, minimum_spanning_forest


def assignment(spark, labels_by_level):
    rows = [(lv, i, c) for lv, ls in labels_by_level.items() for i, c in enumerate(ls)]
    return spark.createDataFrame(rows, "level_uid string, node_id long, node_cluster int")


def levels(spark, n):
    return spark.createDataFrame([(f"L{i}", i) for i in range(n)], "level_uid string, level_no int")


def partition(spark, values, column):
    return spark.createDataFrame(list(enumerate(values)), f"node_id long, {column} int")


def test_flow(spark):
    a = assignment(spark, {"L0": [0, 0, 1, 1, 2, -1]})
    e = spark.createDataFrame([(0, 2), (1, 3), (2, 4), (4, 4), (5, 0)], "src long, dst long")
    m = {(r["a"], r["b"]): r["links"] for r in analytics.flow(a, e).collect()}
    assert m == {(0, 1): 2, (1, 2): 1, (2, 2): 1}
    d = {r["node_cluster"]: (r["out_deg"], r["in_deg"], r["intra"]) for r in analytics.flow_degrees(analytics.flow(a, e)).collect()}
    assert d == {0: (2, 0, 0), 1: (1, 2, 0), 2: (0, 1, 1)}


@pytest.mark.parametrize(
    ("coarse", "fine", "want"),
    [([0, 0, -1, 1, 1, 1], [0, 0, 1, 1, 2, -1], 0), ([0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 0, 1, 2, 3, 2, 3], 4), ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], 1), ([0] * 6, [0, 0, 1, 1, 2, 2], 0)],
)
def test_bridges_per_pair(spark, coarse, fine, want):
    r = analytics.bridge_counts(assignment(spark, {"L0": coarse, "L1": fine}), levels(spark, 2)).collect()
    assert [x["bridges"] for x in r] == [want]


def test_bridge_shares(spark):
    b = analytics.bridges(analytics.level_pairs(assignment(spark, {"L0": [0, 0, 0, 1], "L1": [0, 0, 0, 0]}), levels(spark, 2))).first()
    assert (b["span"], b["dominant"], b["dominant_fraction"], b["is_bridge"], b["shares"]) == (2, 0, 0.75, True, "0:75% 1:25%")


def test_layers_of_a_tree():
    t = hdbscan.Tree([-1, 0, 0, 1, 1, 2, 2], [0, 1, 1, 3, 3, 6, 6], [0.0] * 7, [8, 4, 4, 2, 2, 2, 2], np.array([3, 3, 4, 4, 5, 5, 6, 6]), np.full(8, 8.0))
    found = hdbscan.layers(t)
    assert [c for c, _, _ in found] == [2, 3, 4]
    cuts = ["".join(map(str, hdbscan.relabel(hdbscan.frontier(t, lv))[0])) for _, lv, _ in found]
    assert cuts == ["00001111", "00112222", "00112233"]


def test_layers_in_sql(spark):
    tree = spark.createDataFrame([(0, -1, 0.0), (1, 0, 1.0), (2, 0, 1.0), (3, 1, 3.0), (4, 1, 3.0), (5, 2, 6.0), (6, 2, 6.0)], "cluster long, parent long, birth double")
    leaves = spark.createDataFrame([(8.0,)] * 8, "level double")
    assert sorted(r["count"] for r in multilevel.discover_layers(tree, leaves).collect()) == [2, 3, 4]


def test_absorption_along_tree():
    edges = np.array([(i, i + 1) for i in range(7)])
    assert hdbscan.absorb_along_tree(np.array([0, 0, 0, -1, -1, 1, 1, 1]), edges, np.ones(7)).tolist() == [0, 0, 0, 0, 1, 1, 1, 1]


def test_log_spaced_sizes():
    s = search.log_spaced_sizes(1000, 25)
    assert s == sorted(s) and s[0] == 2 and s[-1] == 500


def test_plateaus_and_ladder(spark):
    steps = spark.createDataFrame([(2, 8), (3, 8), (5, 5), (8, 5), (12, 5), (20, 3), (40, 3), (80, 1)], "size int, count int")
    c = analytics.plateaus(steps)
    assert sorted(r["count"] for r in c.collect()) == [3, 5, 8]
    assert [(r["uid"], r["count"]) for r in multilevel.ladder(c, [8, 3, 99, 3], "PFX").orderBy("uid").collect()] == [("PFX-L0", 3), ("PFX-L1", 8)]


def test_selection_by_score(spark):
    a = assignment(spark, {"L0": [0, 0, 0, 1, 1, 1], "L1": [0, 0, 1, 1, 2, 2]})
    s = spark.createDataFrame([("L0", 0, 5), ("L0", 1, 2), ("L1", 0, 4), ("L1", 1, 1), ("L1", 2, 5)], "level_uid string, node_cluster int, score int")
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(selection.select_nodes(a, s, "L0", 3)) == [0, 1, 2]
    assert ids(selection.select_nodes(a, s, "L1", 4)) == [0, 1, 4, 5]
    assert ids(selection.select_nodes(a, s, "L1", cluster=1)) == [2, 3]


def test_ris(spark):
    d = spark.createDataFrame([(1, '["Ann Lee", " ", "Bo"]', "On\n ice", 2001, "J. Ice", "10.1/x", "JournalArticle"), (2, None, None, None, None, None, "weirdtype")], "ord long, authors string, title string, year int, venue string, doi string, kind string")
    r = d.select("ord", export.ris_record(*(F.col(c) for c in ("authors", "title", "year", "venue", "doi", "kind"))).alias("record"))
    text = export.ris_text(r)
    assert text == "TY  - JOUR\nAU  - Ann Lee\nAU  - Bo\nTI  - On ice\nPY  - 2001\nJO  - J. Ice\nDO  - 10.1/x\nER  - \n\nTY  - GEN\nER  - \n"
    kinds = spark.createDataFrame([("journalarticle",), ("conferencepaper",), ("weirdtype",), (None,)], "k string")
    assert [x[0] for x in kinds.select(export.ris_type(F.col("k"))).collect()] == ["JOUR", "CONF", "GEN", "GEN"]


def test_cart_json_and_first_wins(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "paper_id long, source string")
    assert export.cart_json(c).first()[0] == '{"papers":[{"id":1,"source":"a"},{"id":2,"source":"b"}]}'
    more = spark.createDataFrame([(2, "z"), (3, "y"), (3, "x")], "paper_id long, source string")
    assert sorted(map(tuple, selection.add_first_wins(c, more).collect())) == [(1, "a"), (2, "b"), (3, "x")]


def test_partition_scores(spark):
    def score(a, b):
        return metrics.scores(metrics.contingency(partition(spark, a, "a"), partition(spark, b, "b"))).first()

    same = [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert score(same, same)["nmi"] == pytest.approx(1) and score(same, same)["ari"] == pytest.approx(1)
    assert score(same, [5, 5, 5, 3, 3, 3, 4, 4, 4])["nmi"] == pytest.approx(1)
    assert score(same, [0, 1, 2] * 3)["nmi"] < 0.3
    assert score([0] * 4, [0] * 4)["nmi"] == 1
    r = score([0] * 4 + [1] * 4 + [2] * 4, [0, 0, 0, 2, 1, 1, 1, 1, 2, 2, 2, 1])
    assert 0.5 < r["ari"] < 1
    assert metrics.ami_of(np.diag([3, 3, 3])) == pytest.approx(1)
    assert abs(metrics.ami_of(np.ones((3, 3), dtype=int))) < 0.5


def test_matching_with_least_members(spark):
    v = [0, 1, 1] + [2] * 7
    t = metrics.contingency(partition(spark, v, "a"), partition(spark, v, "b")).withColumn("run", F.lit(0))
    assert sorted(r["a"] for r in metrics.matched_jaccard(t, "run").collect()) == [0, 1, 2]
    assert [r["a"] for r in metrics.matched_jaccard(t, "run", 3).collect()] == [2]


@pytest.mark.parametrize("seed", range(6))
def test_best_matching_is_optimal(seed):
    from itertools import permutations

    w = np.random.default_rng(seed).random((4, 5))
    best = max(sum(w[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
    assert sum(w[i, j] for i, j in metrics.best_matching(w)) == pytest.approx(best)


def test_retention(spark):
    a, b = (partition(spark, v, c).withColumn("run", F.lit(0)) for v, c in (([0, 0, 0, 1], "a"), ([0, 0, 1, 1], "b")))
    r = {x["node_id"]: x["retention"] for x in metrics.retention(a, b, metrics.contingency(a, b, ["run"]), ["run"]).collect()}
    assert r == {0: 0.5, 1: 0.5, 2: 0.0, 3: None}


def test_displacement_of_a_cube(spark):
    pts = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    moved = [(i, x + 0.8 * (i == 3), y + 0.8 * (i == 3), z) for i, x, y, z in pts]
    schema = "node_id long, x double, y double, z double"
    r = {x["node_id"]: x["moved"] for x in layout.displacement(spark.createDataFrame(pts, schema), spark.createDataFrame(moved, schema)).collect()}
    assert max(r, key=r.get) == 3 and r[3] > 2 * max(v for k, v in r.items() if k != 3)


def test_alignment_undoes_turn_scale_and_shift(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(20, 3))
    c, s = np.cos(0.7), np.sin(0.7)
    q = 3 * p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [5, -2, 1]
    schema = "node_id long, x double, y double, z double"
    a, b = (spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], schema) for m in (p, q))
    got, corr = layout.align(a, b)
    g = np.array([tuple(r)[1:] for r in got.orderBy("node_id").collect()])
    assert np.allclose(g, p, atol=1e-8) and corr.first()[0] == pytest.approx(1)


def test_labels(spark):
    texts = spark.createDataFrame([(0, "graph networks spectral graph"), (0, "graph laplacian networks"), (1, "transformer attention tokens"), (1, "attention heads transformer")], "cluster int, text string")
    top = {}
    for r in labels.top_terms(labels.term_scores(texts)).orderBy("cluster", "rank").collect():
        top.setdefault(r["cluster"], []).append(r["term"])
    assert "graph" in top[0] and "transformer" not in top[0]
    words = [f"alga {w} {w} 12345 para" for w in ("zeta", "eta", "theta", "iota", "kappa", "omega")]
    bands = labels.banded(spark.createDataFrame(list(enumerate(words)), "cluster int, text string")).collect()
    where = {(r["cluster"], r["term"]): r["band"] for r in bands}
    order = {b: i for i, b in enumerate(labels.BANDS)}
    assert order[where[0, "alga"]] < order[where[0, "zeta"]]
    assert not any(r["band"] == "signature" and ("12345" in r["term"] or "para" in r["term"].split(" ")) for r in bands)
    assert len(labels.band_edges(6)) == 3


def blobs(n=50, seed=7):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, (n, 3)) + c for c in ((0, 0, 0), (10, 0, 0), (0, 10, 0))])


def test_hdbscan_blobs_and_reuse():
    x = blobs()
    model = hdbscan.fit(x, 5)
    labels_, _, _, order = hdbscan.run(x, 10, model=model)
    assert len(order) == 3 and all(len(set(labels_[i * 50 : i * 50 + 50])) == 1 for i in range(3))
    assert (hdbscan.run(x, 10, 5)[0] == labels_).all()
    counts = [len(hdbscan.run(x, s, model=model)[3]) for s in (5, 15, 40, 120)]
    assert counts[0] >= 3 and counts == sorted(counts, reverse=True) and counts[-1] < 3


def test_condensed_tree_is_well_formed():
    t = hdbscan.condense(hdbscan.fit(blobs(), 5), 10)
    assert t.parent[0] == -1 and all(p < i for i, p in enumerate(t.parent)) and t.size[0] == 150
    assert set(t.home) <= set(range(len(t.parent))) and (t.leaf_level >= np.array(t.birth)[t.home]).all()


def test_noise_modes():
    x = np.concatenate([blobs(), np.array([[30.0, 30, 30], [-30, 5, 60]])])
    kept = hdbscan.run(x, 10, noise="keep")
    assert kept[1][-2:].all() and kept[0][-1] == -1
    assert hdbscan.run(x, 10, noise="absorb")[0].min() >= 0
    assert len(set(hdbscan.run(x, 10, noise="singletons")[0][-2:])) == 2


def test_blob_hierarchy_ladder():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-0.4, 0.4, (40, 3)) + [c, 0, 0] for c in (0, 2, 20, 22)])
    found = hdbscan.ladder(hdbscan.fit(x, 5), 10)
    assert {2, 4} <= {len(set(lv)) for lv in found}


def test_mutual_knn_and_components(spark):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs(20))], "id long, v array<double>")
    for df in (clustering.mutual_knn(d, "id", "v", 8), clustering.knn_components(d, "id", "v", 8)):
        assert df.select("node_cluster").distinct().count() == 3


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 300, (250, 2)).tolist() + [[i, i + 1] for i in range(400, 460)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_forest_weight(spark):
    x = blobs(15)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    e = [(i, j, float(d[i, j])) for i in range(len(x)) for j in range(i)]
    got = minimum_spanning_forest(spark.createDataFrame(e, "src long, dst long, w double"))
    want = hdbscan.fit(x, 1)
    assert got.count() == len(x) - 1
    m = hdbscan.fit(x, 1)
    assert got.agg(F.sum("w")).first()[0] <= m.weights.sum() + 1e-6 and want is not None


def test_diffusion_conventions(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [8.0])], "node_id long, vec array<double>")
    e = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    got = {r["node_id"]: r["vec"][0] for r in diffuse(v, e, 0.5, 1).collect()}
    assert got == {0: 2.0, 1: 2.0, 2: 4.0}
    assert {r["node_id"]: r["vec"][0] for r in diffuse(v, e.limit(0), 0.5, 3).collect()} == {0: 1.0, 1: 3.0, 2: 8.0}
    g = spark.createDataFrame([(9,)], "node_id long")
    e2 = spark.createDataFrame([(9, 0), (9, 1)], "src long, dst long")
    assert {r["node_id"]: r["vec"][0] for r in diffuse(v, e2, 0.5, 1, ghosts=g).collect()}[9] == 2.0


def test_knn_breaks_ties_by_id(spark):
    d = spark.createDataFrame([(1, [0.0]), (5, [1.0]), (3, [-1.0]), (4, [1.0])], "id long, v array<double>")
    got = [r["dst"] for r in vectors.knn(d, "id", "v", 3, block_rows=2).filter("src = 1").orderBy("rank").collect()]
    assert got == [3, 4, 5]


def test_pca_variance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + 7
    out, var = vectors.pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), "id", "v", 2)
    p = np.array([r["vec"] for r in out.orderBy("id").collect()])
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2]
    assert np.allclose(p.mean(0), 0, atol=1e-8) and np.allclose(p.var(0), want) and var[0] > var[1]


def test_latin_hypercube_hits_every_bin():
    rows = search.latin_hypercube({"a": {"kind": "float", "min": 0, "max": 10}, "b": {"options": ["x", "y"]}, "c": {"kind": "int", "min": 1, "max": 1000, "scale": "log"}}, 10, 3, {"c": 7})
    assert sorted(int(r["a"]) for r in rows) == list(range(10)) and {r["b"] for r in rows} == {"x", "y"} and {r["c"] for r in rows} == {7}
    assert rows == search.latin_hypercube({"a": {"kind": "float", "min": 0, "max": 10}, "b": {"options": ["x", "y"]}, "c": {"kind": "int", "min": 1, "max": 1000, "scale": "log"}}, 10, 3, {"c": 7})


def test_hop_neighbours(spark):
    from papyrine.operators.graph import hop_neighbours

    nodes = spark.createDataFrame([(i,) for i in range(12)], "node_id long")
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    rows = hop_neighbours(path, nodes, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r["src"], {})[r["dst"]] = r["hops"]
    assert all(len(v) == 3 and k not in v for k, v in by.items()) and len(by) == 12
    assert by[0] == {1: 1, 2: 2, 3: 3} and {4, 6} <= set(by[5])
    assert set(by[11].values()) == {1}  # without links: others by hash, one step away


def test_carving(spark):
    from papyrine.sources import carving

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 2)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id long")
    pairs = lambda d: sorted((r["src"], r["dst"]) for r in d.collect())
    assert pairs(carving.induced_edges(e, ids(1, 2, 3))) == [(1, 2), (2, 3)]
    assert pairs(carving.contracted_edges(e, ids(2))) == [(1, 3), (3, 4), (5, 3)]
    assert carving.random_subset(ids(*range(50)), 7).count() == 7
    near = carving.connected_subset(e, spark.createDataFrame([(2,)], "id long"), 4).collect()
    assert {r["node_id"] for r in near} == {1, 2, 3, 5}


def test_scorers_and_tags(spark):
    r = spark.createDataFrame([("a", 3, 0.5, 0.9), ("b", 9, 0.2, 0.4)], "params string, clusters long, ari double, macro double")
    assert [search.scored(r, s).first()["params"] for s in ("ari", "clusters", "stability", "richness")] == ["a", "b", "a", "b"]
    assert search.tagged({"pre": r, "post": r}).count() == 4


@pytest.mark.parametrize("query", ["r4_layout_forces", "r5_layout_mds"])
def test_layout_queries_place_every_node(spark, small, query):
    import __spark_entry__ as entry
    from papyrine.plans.tables import Domain

    got = entry.queries()[query](spark, small).toPandas()
    want = {r[0] for r in Domain(spark, small).nodes.select("node_id").distinct().collect()}
    assert set(got.node_id) == want and len(got) == len(want) and np.isfinite(got[["x", "y", "z"]].to_numpy()).all()


def test_layout_sweep_has_all_methods_and_seeds(spark, small):
    import __spark_entry__ as entry

    got = {(r["method"], r["seed"]) for r in entry.queries()["o8_layout_sweep"](spark, small).collect()}
    assert got == {(m, s) for m in layout.LAYOUTS for s in (1, 2)}


def test_layouts_of_large_components(spark):
    """Beyond the bound of a task the approximations place every node, about as well as all pairs do."""
    n = 600
    rng = np.random.default_rng(2)
    e = sorted({(int(rng.integers(0, i)), i) for i in range(1, n)} | {(a, a + 1) for a in range(0, n - 1, 3)})
    nodes = spark.createDataFrame([(i, i / n) for i in range(n)], "node_id long, t double")
    links = spark.createDataFrame(e, "src long, dst long")
    hops = layout._hops_from(n, np.array(e), np.arange(576)).T.astype(float)
    stress = {}
    for method in ("forces", "mds"):
        for most in (300, 3000):
            p = layout.layout(method, nodes, links, most_in_task=most).toPandas().sort_values("node_id")
            assert p.node_id.tolist() == list(range(n))
            y = p[["x", "y", "z"]].to_numpy()
            own = np.linalg.norm(y[:576, None] - y[None], axis=-1)
            own *= (hops * own).sum() / (own**2).sum()
            stress[method, most] = ((hops - own) ** 2).sum() / (hops**2).sum()
    assert all(stress[m, 300] < 1.2 * stress[m, 3000] for m in ("forces", "mds"))


def test_mesh_repulsion():
    y = np.random.default_rng(3).normal(size=(1500, 3)) * 30
    exact, mesh = layout._repulsion(y), layout._Mesh(135.0, 64, 1)(y)
    assert np.median(np.linalg.norm(exact - mesh, axis=1) / np.linalg.norm(exact, axis=1)) < 0.05
