import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import clustering, comparison, ghosts, graph, hdbscan, instrumentation, layout, numbering, search, taste, validation, vectors
from papyrine.plans import lanes
from papyrine.sources import corpus, registry


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "node_id long, node_cluster int")


def test_comparison_of_partitions(spark):
    """Hand-computed: four nodes change places among three clusters of four."""
    c = comparison.compare(labels(spark, [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]), labels(spark, [0, 0, 0, 2, 1, 1, 1, 1, 2, 2, 2, 1]))
    a = c.aggregate.first()
    assert 0.5 < a["ari"] < 1 and 0.5 < a["macro"] < 1 and a["clusters_pre"] == a["clusters_post"] == 3 and a["reorganised"] == 2
    rows = {r["a"]: r for r in c.clusters.collect()}
    assert (rows[0]["matched"], rows[0]["retained"], rows[0]["lost"], rows[0]["biggest"]) == (0, 3, 1, 0) and rows[1]["jaccard"] == pytest.approx(4 / 5)
    assert a["macro"] == pytest.approx((4 * 3 / 4 + 4 * 4 / 5 + 4 * 3 / 5) / 12)
    top = c.top_movers(2).collect()
    assert [r["node_id"] for r in top] == [3, 11] and top[0]["retention"] == 0.0


def test_comparison_with_noise(spark):
    c = comparison.compare(labels(spark, [0, 0, -1, 1, 2, 2]), labels(spark, [-1, -1, 0, 5, -1, 5]))
    r = {x["node_id"]: x["retention"] for x in c.nodes.collect()}
    assert r == {0: None, 1: None, 2: None, 3: 1.0, 4: None, 5: 0.0}
    k = {x["a"]: (x["matched"], x["biggest"], x["biggest_count"]) for x in c.clusters.collect()}
    assert k[0] == (-1, -1, 2) and k[2][1:] == (5, 1) and k[1][0] == 5
    assert comparison.compare(labels(spark, []), labels(spark, [])).clusters.count() == 0


def ghost_graph(spark):
    """Two far groups of six, a ghost that bridges them (12) and one inside a group (13)."""
    rng = np.random.default_rng(7)
    x = np.concatenate([5 + 0.6 * rng.normal(size=(6, 8)), -5 + 0.6 * rng.normal(size=(6, 8))])
    nodes = spark.createDataFrame([(i, i >= 12, [0.0] if i < 12 else None, float(i) / 14) for i in range(14)], "node_id long, is_ghost boolean, base_pos array<double>, t double")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, vec array<double>")
    e = [(i, i + 1) for i in (*range(5), *range(6, 11))] + [(12, 0), (12, 6), (13, 1), (13, 2)]
    return nodes, v, spark.createDataFrame(e, "src long, dst long")


def test_ghost_instrumentation(spark):
    from papyrine.operators.dimred import diffuse

    nodes, v, e = ghost_graph(spark)
    g = nodes.filter("is_ghost").select("node_id")
    fused = diffuse(v, e, 0.3, 4, ghosts=g).cache()
    var = instrumentation.variance_ratios(fused, g).first()
    assert var["real"] > 0 and 0 < var["ratio"] < 1
    energy = {r["kind"]: r for r in instrumentation.link_energy(fused, e, g).collect()}
    assert energy["real-ghost"]["per_link"] > energy["real-real"]["per_link"] and energy["real-ghost"]["links"] == 4
    label = lambda d: hdbscan.cluster(d, "node_id", "vec", min_size=2, min_samples=2).select("node_id", "node_cluster")
    s = instrumentation.bridge_signal(nodes, e, v, label, nulls=4)
    r = s.first()
    assert r["pairs"] >= 1 and r["mean_dist"] > 0 and r["ratio"] < 1 and r["lift"] is not None
    c = instrumentation.contamination(fused, diffuse(v, e.filter("src < 12 and dst < 12"), 0.3, 4))
    assert c.first()["mean_moved"] >= 0 and c.first()["rank_correlation"] > 0.5 and c.first()["nodes"] == 12
    text = instrumentation.report(instrumentation.variance_ratios(fused, g), instrumentation.link_energy(fused, e, g), s, c)
    assert len(text.splitlines()) == 5 and "Bridged pairs: 1" in text


def test_rewiring_keeps_degrees_and_ghost_links(spark):
    n = spark.createDataFrame([(i, i >= 8, [0.0] if i < 8 else None) for i in range(11)], "node_id long, is_ghost boolean, base_pos array<double>")
    e = spark.createDataFrame([*((8, i) for i in range(7)), (9, 8), (9, 1), (10, 9)], "src long, dst long")
    rows = {}
    for r in ghosts.rewire(n, e).collect():
        rows.setdefault(r["src"], []).append(r["dst"])
    assert {k: len(set(v)) for k, v in rows.items()} == {8: 8, 9: 3, 10: 1} and rows[10] == [9]


def test_long_chain_has_its_nearest(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node_id long")
    path = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    got = {(r["dst"], r["hops"]) for r in graph.hop_neighbours(path, nodes, 15).filter("src = 0").collect()}
    assert got == {(i, i) for i in range(1, 16)}


def test_unfinished_rounds_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, max_rounds=1)


def test_numbering_by_ranges(spark):
    df = spark.createDataFrame([(x,) for x in np.random.default_rng(0).permutation(1000).tolist()], "v long").repartition(7)
    assert {(r["v"], r["i"]) for r in numbering.numbered(df, "v", "i").collect()} == {(i, i) for i in range(1000)}
    down = numbering.running_sum(df, "v", F.col("v"), "s", True).filter("v = 998").first()
    assert down["s"] == 999 + 998


def test_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.1 + c for c in ([0, 0], [0, 9], [9, 0], [9, 9])])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = [r["cluster"] for r in vectors.kmeans(df, "id", "v", 4).orderBy("id").collect()]
    assert got == [0] * 30 + [1] * 30 + [2] * 30 + [3] * 30


def blobs(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(-0.4, 0.4, (n, 3)) + [c, 0, 0] for c in (0, 2, 20, 22)])
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


def test_sweep_lane_and_commit(spark):
    """Four groups in two pairs: 2 and 4 clusters hold over runs of sizes, come back, and become levels."""
    df = blobs(spark)
    state = lanes.sweep_lane({"nodes": df}, df, "id", "v", rounds=4)
    c = {r["count"]: r for r in state["candidates"].collect()}
    assert {2, 4} <= set(c) and c[2]["stability"] > 0.8 and c[4]["stability"] > 0.8
    out = lanes.commit_lane(state, [4, 2, 4, 99])
    assert sorted(tuple(r) for r in out["levels"].collect()) == [("ML-L0", 0), ("ML-L1", 1)]
    assert out["assign"].groupBy("level_uid").agg(F.countDistinct("node_cluster").alias("k")).orderBy("level_uid").toPandas()["k"].tolist() == [2, 4]
    assert out["bridges"].filter("is_bridge").count() == 0
    prep = lanes.scoring_prep(out).collect()
    assert len(prep) == 6 and all(r["score"] is None and r["label"] == "(unlabelled)" for r in prep)


def test_cluster_flow_and_layout_lanes(spark):
    n = 160
    df = blobs(spark)
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, 0), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i, i >= n, [0.0] if i < n else None, i / 200) for i in range(n + 2)], "node_id long, is_ghost boolean, base_pos array<double>, t double")
    state = lanes.cluster_lane({"nodes": nodes, "edges": e}, df, "id", "v", [{"scope": "global", "min_size": 50}, {"scope": "within-parent", "min_size": 10}], bootstrap={"rounds": 3, "min_size": 10})
    a = {(r["level_uid"], r["node_id"]): r["node_cluster"] for r in state["assign"].collect()}
    assert a["L1", n] == a["L1", 0] and a["L1", n + 1] == 4 and a["L0", n + 1] == 2  # the last one has no links: a cluster of its own
    assert state["stability"].count() == 4 and state["bridges"].count() >= 4
    state = lanes.flow_lane(state, e)
    assert state["edges"].count() == n and "flow" in state
    base = df.select(F.col("id").alias("node_id"), *(F.col("v")[i].alias(c) for i, c in enumerate("xyz")))
    out = lanes.layout_lane(state, "mds", base)
    assert out["layout"].count() == n and out["layout_fit"].first()[0] > 0
    with pytest.raises(ValueError):
        lanes.layout_lane(state, "mds", base.unionByName(base))
    again = lanes.renewed(state, nodes=nodes)
    assert "assign" not in again and "bridges" in again["stale"]


def test_ingest(spark, small):
    state = lanes.ingest(spark, "tables", path=small)
    assert state["nodes"].count() > 0 and state["stale"] == []
    assert lanes.ingest(spark, "toy", {"assign": 1, "nodes": 2})["stale"] == ["assign"]


def test_sweep_across_algorithms(spark):
    df = blobs(spark, 20)
    truth = spark.createDataFrame([(i, i // 20) for i in range(80)], "node_id long, label int")
    settings = {"hdbscan": [{"min_size": 5}, {"min_size": 30}], "kmeans": [{"k": 4}], "mutualKNN": [{"mutual_k": 6}], "connected-components": [{"k": 5}]}
    rows = search.across(settings, df, "id", "v", truth).collect()
    assert len(rows) == 5 and {r["algorithm"] for r in rows} == set(settings) and rows[0]["ari"] == pytest.approx(1.0)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    best = search.across({"hdbscan": settings["hdbscan"]}, df, "id", "v", scorer="stability", top=1, rounds=3).collect()
    assert len(best) == 1 and best[0]["macro"] > 0.5
    assert search.seed_of({"a": 1, "b": 2}) == search.seed_of({"b": 2, "a": 1}) != search.seed_of({"a": 2, "b": 2})


def test_target_range_with_bootstrap(spark):
    df = blobs(spark, 20)
    schema = {"min_size": {"kind": "int", "min": 3, "max": 40}}
    near = search.target_range(df, "id", "v", schema, 4, 4, probes=5).collect()
    assert near[0]["in_range"] and near[0]["score"] == 1.0 and near[0]["clusters"] == 4
    boot = search.target_range(df, "id", "v", schema, 4, 4, probes=5, bootstrap={"rounds": 2}).collect()
    assert {r["params"] for r in boot} == {r["params"] for r in near} and all(0 <= r["score"] <= 1 for r in boot)
    with pytest.raises(ValueError):
        search.target_range(df, "id", "v", schema, 5, 4)


def test_dimension_sweep_embeds_anew(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 8)) + 12 * np.eye(8)[k] for k in range(3)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    runs = search.dimension_runs(df, "id", "v", [2, 4], [1, 2], noise=8, neighbours=10, min_size=10)
    assert runs.groupBy("d", "s").count().count() == 4 and runs.count() == 480
    out = {(r["d1"], r["d2"]): r for r in search.compared_dimensions(runs).collect()}
    assert out[2, 2]["mean"] == pytest.approx(1) and out[2, 4]["mean"] > 0.8 and out[2, 4]["clusters_1"] == pytest.approx(3, abs=1)
    assert search.dimension_cost(5000, [50, 100], [1, 2, 3]) == pytest.approx(3 + 3 * 8 * 3)


def test_tree_with_strays_is_sound(spark):
    tree, leaves = hdbscan.tree_tables(blobs(spark, 20), "id", "v", 5)
    assert tuple(validation.tree_violations(tree, leaves).first()) == (1, 0, 0, 0)
    more, homes = ghosts.lift_tree(tree, leaves, spark.createDataFrame([(900,), (901,)], "node_id long"))
    assert tuple(validation.tree_violations(more, homes).first()) == (1, 0, 0, 0) and more.count() == tree.count() + 1 and homes.count() == leaves.count() + 2
    same, _ = ghosts.lift_tree(tree, leaves, spark.createDataFrame([], "node_id long"))
    assert same.count() == tree.count()


def test_subset_in_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    (tmp_path / "index.json").write_text(json.dumps([70, {"id": 71, "structural": True}, 72]))
    (tmp_path / "years.json").write_text(json.dumps({"0": 2000, "1": None, "2": 2010}))
    (tmp_path / "edges.json").write_text(json.dumps([[0, 1], [0, 1], [2, 0], [1, 9], [2, 2]]))
    p = {k: str(tmp_path / f) for k, f in (("matrix", "m.npy"), ("index", "index.json"), ("years", "years.json"), ("edges", "edges.json"))}
    got = registry.read(spark, "subset", **p)
    n = {r["paper_id"]: (r["node_id"], r["t"], r["structural"]) for r in got["nodes"].collect()}
    assert n == {70: (0, 1.0, False), 71: (1, 1.0, True), 72: (2, 0.0, False)}
    assert sorted(map(tuple, got["edges"].collect())) == [(0, 2), (1, 0)] and got["vectors"].count() == 3
    assert registry.read(spark, "subset", **p | {"years": None, "edges": None})["edges"].count() == 0
    (tmp_path / "index.json").write_text(json.dumps({"0": 70, "8": 71}))
    with pytest.raises(ValueError):
        registry.read(spark, "subset", **p)


def test_corpus_is_assembled_or_fails(spark):
    cols = "paper_id long, title string, abstract string, year int, is_stub int, is_rejected int"
    papers = spark.createDataFrame([(1, "a", "x", 2001, 0, 0), (2, "b", "y", 2003, 0, 0), (3, "c", None, None, 0, 0), (4, "d", "z", 2000, 1, 0), (5, "e", "z", 2000, 0, 1)], cols)
    index = spark.createDataFrame([(0, 2), (1, 1)], "row_no long, paper_id long")
    cites = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 3), (1, 5), (2, 2), (None, 1)], "citing_id long, cited_id long")
    out = corpus.assemble(index, papers, cites)
    assert {r["paper_id"]: r["node_id"] for r in out["nodes"].collect()} == {2: 0, 1: 1, 3: 2, 4: 3}
    assert sorted(map(tuple, out["edges"].collect())) == [(1, 0), (1, 2), (3, 2)] and out["dropped"].first()[0] == 1
    with pytest.raises(ValueError, match="1 only in the table"):
        corpus.assemble(index.filter("row_no = 0"), papers, cites)


def test_stability_needs_no_order(spark):
    df = blobs(spark, 20)
    ref = hdbscan.cluster(df, "id", "v", min_size=8).select("node_id", "node_cluster")
    a, b = (clustering.stability_summary(clustering.bootstrap(x, "id", "v", ref, rounds=3, min_size=4)).first() for x in (df, df.repartition(5)))
    assert a == b


def test_layouts_and_their_parameters(spark):
    nodes = spark.createDataFrame([(i, i / 10) for i in range(12)], "node_id long, t double")
    ring = spark.createDataFrame([(i, (i + 1) % 10) for i in range(10)], "src long, dst long")
    for m in layout.LAYOUTS:
        p = layout.layout(m, nodes, ring, iterations=50).toPandas()
        assert sorted(p.node_id) == list(range(12)) and np.isfinite(p[["x", "y", "z"]].to_numpy()).all()
    # On a ring the nearest places belong to linked nodes.
    p = layout.layout("umap-graph", nodes, ring, neighbours=5).filter("node_id < 10").toPandas().sort_values("node_id")
    y = p[["x", "y", "z"]].to_numpy()
    d = np.linalg.norm(y[:, None] - y[None], axis=-1)
    ring_d = np.minimum((a := np.abs(np.arange(10)[:, None] - np.arange(10)[None])), 10 - a)
    assert d[ring_d == 1].mean() < d[ring_d >= 4].mean()
    for bad, error in (({"steps": 3}, TypeError), ({"iterations": 5}, ValueError)):
        with pytest.raises(error):
            layout.parameters("mds", **bad)
    with pytest.raises(KeyError):
        layout.layout("spiral", nodes, ring)


def test_ways_of_links(spark):
    nodes = spark.createDataFrame([(i, i / 10) for i in range(4)], "node_id long, t double")
    e = spark.createDataFrame([(0, 1), (0, 1), (2, 2), (3, 9), (None, 1)], "src long, dst long")
    assert [tuple(r) for r in taste.citations("imported", nodes, imported=e).collect()] == [(0, 1)]
    for how, error in ((dict(method="imported"), ValueError), (dict(method="taste-network"), ValueError), (dict(method="guess"), KeyError), (dict(method="imported", budget=3), TypeError)):
        with pytest.raises(error):
            taste.citations(nodes=nodes, **how)


def test_toy_source_knows_its_limit(spark):
    got = registry.read(spark, "toy", nodes=120)
    assert 0 < got["bayes"].first()["ari"] <= 1
