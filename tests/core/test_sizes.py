"""Ways that grow with partitions and nodes as they should: none does more than its result needs."""

import itertools
import math

import numpy as np
import pytest

from papyrine.operators import comparison, metrics, space, vectors
from papyrine.plans import catalog


def refuse(*_):
    raise AssertionError("this step grows faster than the result needs")


@pytest.mark.parametrize("name", ["e16_jaccard_classes", "n9_node_retention", "b6_top_mover_records", "n9_aggregate", "n9_cluster_moves"])
def test_result_needs_no_matching(spark, small, monkeypatch, name):
    monkeypatch.setattr(comparison, "_matched", refuse)
    assert catalog.queries()[name](spark, small).count() > 0


def by_every_overlap(table):
    """The adjusted information as it is defined, cluster by cluster and overlap by overlap."""
    n = int(table.sum())
    a, b = table.sum(1), table.sum(0)
    lf = [math.lgamma(i + 1) for i in range(n + 1)]
    h = lambda c: -sum(v / n * math.log(v / n) for v in c)
    mi = sum(table[i, j] / n * math.log(n * table[i, j] / (a[i] * b[j])) for i, j in zip(*np.nonzero(table), strict=True))
    e = sum(k / n * math.log(n * k / (x * y)) * math.exp(lf[x] + lf[y] + lf[n - x] + lf[n - y] - lf[n] - lf[k] - lf[x - k] - lf[y - k] - lf[n - x - y + k]) for x in a for y in b for k in range(max(1, x + y - n), min(x, y) + 1))
    return (mi - e) / (max(h(a), h(b)) - e)


@pytest.mark.parametrize("seed", range(3))
def test_adjusted_information_of_uneven_sizes(spark, seed):
    rng = np.random.default_rng(seed)
    m = np.floor(rng.pareto(0.7, (9, 12)) * (rng.random((9, 12)) < 0.6)).astype(int).clip(0, 3000)
    m = m[m.sum(1) > 0][:, m.sum(0) > 0]
    want = by_every_overlap(m)
    assert metrics.ami_of(m) == pytest.approx(want, abs=1e-9)
    t = spark.createDataFrame([("r", int(i), int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "run string, a int, b int, n long")
    assert metrics.ami(t, "run").first()["ami"] == pytest.approx(want, abs=1e-9)


def test_adjusted_information_of_level_pairs_needs_no_dense_table(spark, small, monkeypatch):
    monkeypatch.setattr(metrics, "_matrix", refuse, raising=False)
    assert catalog.queries()["n3_ami"](spark, small).count() == 6


def test_adjusted_information_of_many_clusters():
    """Four thousand clusters of one size a side: one pair of sizes, not sixteen million pairs of clusters."""
    from time import perf_counter

    began, m = perf_counter(), np.zeros((4000, 4000), dtype=int)
    m[np.arange(4000), np.arange(4000)] = 5
    assert metrics.ami_of(m) == pytest.approx(1) and perf_counter() - began < 20


def test_matching_of_many_clusters():
    """Six thousand pairs of clusters, each with a stray in the next: the links are gone through, not all pairs."""
    from time import perf_counter

    n, began = 6000, perf_counter()
    a = np.concatenate([np.arange(n), np.arange(n)])
    b = np.concatenate([np.arange(n), (np.arange(n) + 1) % n])
    w = np.concatenate([np.full(n, 0.4), np.full(n, 0.5)])
    assert sorted(metrics.matching(a, b, w)) == [(i, (i + 1) % n) for i in range(n)]
    assert perf_counter() - began < 10


@pytest.mark.parametrize("seed", range(20))
def test_matching_leaves_rows_alone_where_that_is_best(seed):
    """Few links with equal weights among them, against all ways to pair."""
    rng = np.random.default_rng(seed)
    m = np.round(rng.random((5, 4)) * 4) / 4 * (rng.random((5, 4)) < 0.5)
    best = max(sum(m[p[j], j] for j in range(4)) for p in itertools.permutations(range(5), 4))
    found = metrics.best_matching(m)
    assert sum(m[i, j] for i, j in found) == pytest.approx(best) and len({j for _, j in found}) == len({i for i, _ in found}) == len(found)


@pytest.mark.parametrize("by", ["g", None])
def test_neighbours_in_divided_groups(spark, by):
    """Groups of several regions, whole numbers so that many positions and distances are equal, against all pairs."""
    rng = np.random.default_rng(3)
    x, g, ids = np.round(rng.normal(size=(400, 3)) * 3), np.where(rng.random(400) < 0.6, 0, rng.integers(1, 6, 400)), rng.permutation(900)[:400]
    df = spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, g, strict=True)], "id long, v array<double>, g int")
    want = set()
    for i, v, c in zip(ids, x, g, strict=True):
        others = sorted((((v - w) ** 2).sum(), int(j)) for j, w, e in zip(ids, x, g, strict=True) if j != i and (by is None or c == e))
        want |= {(int(i), j, rank) for rank, (_, j) in enumerate(others[:4], 1)}
    assert {(r["src"], r["dst"], r["rank"]) for r in vectors.knn(df, "id", "v", 4, by=by, block_rows=8).collect()} == want


def test_neighbours_look_at_few_rows(monkeypatch):
    """Twenty thousand rows of one group: a few hundred distances a row, not twenty thousand."""
    seen, squares = [0], space._squares
    monkeypatch.setattr(space, "_squares", lambda a, b: (seen.__setitem__(0, seen[0] + np.broadcast_shapes(a.shape, b.shape)[0] * np.broadcast_shapes(a.shape, b.shape)[1]), squares(a, b))[1])
    src, _, _ = space.nearest(np.random.default_rng(1).normal(size=(20000, 3)), np.arange(20000), 4, 9)
    assert len(src) == 80000 and seen[0] < 20000 * 1000


def test_neighbours_are_found_once_for_neighbourhoods(spark):
    """Rows come by an accumulator each time their neighbours' input is worked out."""
    from papyrine.operators import taste

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = np.random.default_rng(4)
    pos = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(60, 3)))], "node_id long, x double, y double, z double")
    own = spark.createDataFrame([(i, i % 2) for i in range(60)], "node_id long, node_cluster int")
    found = taste.neighbourhoods(pos.mapInArrow(count, pos.schema), own)
    assert found.count() == 60 and seen.value == 60


def test_neighbourhoods_need_no_pairs_of_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(vectors, "_block_pairs", refuse)
    assert catalog.queries()["q2_neighbourhoods"](spark, small).count() > 0


def test_neighbourhoods_of_whole_clusters_need_no_rounds(spark, small, monkeypatch):
    """A cluster that one task holds is joined there: no rounds of joins over all nodes, nor over all neighbours."""
    from papyrine.operators import taste

    for module, name in ((taste, "connected_components"), (space, "connected_components"), (taste, "mutual_pairs"), (taste, "knn")):
        monkeypatch.setattr(module, name, refuse)
    assert catalog.queries()["q2_neighbourhoods"](spark, small).count() > 0


@pytest.mark.parametrize("block_rows", [8, 40, 1000])
def test_mutual_components_of_divided_groups(spark, block_rows):
    """Equal positions and distances, groups of several regions, against all pairs."""
    rng = np.random.default_rng(6)
    x, g, ids = np.round(rng.normal(size=(300, 3)) * 4), np.where(rng.random(300) < 0.6, 0, rng.integers(1, 9, 300)), rng.permutation(900)[:300] - 100
    near = {}
    for i, v, c in zip(ids, x, g, strict=True):
        near[i] = {j for _, j in sorted((((v - w) ** 2).sum(), j) for j, w, e in zip(ids, x, g, strict=True) if j != i and c == e)[:4]}
    want = {i: i for i in ids}
    for _ in ids:
        want = {i: min([want[i], *(want[j] for j in near[i] if i in near[j])]) for i in ids}
    df = spark.createDataFrame([(int(i), int(c), *map(float, v)) for i, v, c in zip(ids, x, g, strict=True)], "id long, grp int, x double, y double, z double")
    got = [tuple(r) for r in space.mutual_components(df, ["x", "y", "z"], 4, block_rows, 9).select("id", "grp", "component").collect()]
    assert sorted(got) == sorted((i, c, want[i]) for i, c in zip(ids.tolist(), g.tolist(), strict=True))


def test_neighbourhoods_of_odd_nodes(spark):
    """A node without a usable position is alone; one in two clusters ties what it is mutual with in either."""
    from papyrine.operators import taste

    pos = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, 9.0, 0.0, 0.0)], "node_id long, x double, y double, z double")
    own = [(1, 0), (2, 0), (3, 0), (4, 0)]
    of = lambda rows: sorted(map(tuple, taste.neighbourhoods(pos, spark.createDataFrame(rows, "node_id long, node_cluster int")).collect()))
    assert of(own) == [(1, 0, 1), (2, 0, 1), (3, 0, 3), (4, 0, 4)]
    assert of([(1, 0), (2, 0), (2, 1), (5, 1)]) == [(1, 0, 1), (2, 0, 1), (2, 1, 1), (5, 1, 1)]
    assert of([(1, -1)]) == []


def test_layout_sweep_finds_components_once(spark, small, monkeypatch):
    """Six layouts and their alignments share the components."""
    from papyrine.operators import layout

    calls, found = [], layout.connected_components
    monkeypatch.setattr(layout, "connected_components", lambda *a, **k: (calls.append(1), found(*a, **k))[1])
    assert catalog.queries()["o8_layout_sweep"](spark, small).count() == 6 and len(calls) == 1


def test_layouts_side_by_side_are_those_of_each(spark):
    """A component of several hundred nodes, a pair and single nodes, by every method: as they come out one by one."""
    from papyrine.operators import layout

    nodes = spark.createDataFrame([(i, i / 400) for i in range(310)], "node_id long, t double")
    links = spark.createDataFrame([*((i, (i * 7 + 1) % 300) for i in range(300)), *((i, i + 1) for i in range(299)), (301, 302)], "src long, dst long")
    jobs = [(m, s, {"iterations": 50}) for m in layout.LAYOUTS for s in (1, 2)]
    rows = {(r["job"], r["node_id"]): (r["x"], r["y"], r["z"]) for r in layout.layouts(jobs, nodes, links, layout.components(nodes, links)).collect()}
    assert len(rows) == 6 * 310
    for i, (m, s, p) in enumerate(jobs[1::2]):
        each = {r["node_id"]: (r["x"], r["y"], r["z"]) for r in layout.layout(m, nodes, links, s, **p).collect()}
        assert all(rows[2 * i + 1, n] == pytest.approx(v) for n, v in each.items())


def _linked_nodes(n, hubs, seed=3):
    """Links of one component, some of them at few nodes."""
    rng = np.random.default_rng(seed)
    e = {(int(rng.integers(0, max(1, i // 3))), i) for i in range(1, n)} | {(int(h), int(v)) for h in range(hubs) for v in rng.choice(n, n // 4, replace=False) if h < v}
    return np.array(sorted(e), dtype=np.int32)


@pytest.mark.parametrize("method", ["forces", "mds", "umap-graph"])
def test_a_large_component_takes_little_memory(method):
    """Of 30,000 nodes and 90,000 links, bytes held at once in the task: steps to all pivots alone were over 500 a node, and all neighbours' rows over 1,000."""
    import tracemalloc

    from papyrine.operators import dimred, layout, steps

    n = 30_000
    e = np.concatenate([_linked_nodes(n, 0), np.sort(np.random.default_rng(1).integers(0, n // 2, (2 * n, 2)) * [1, 2], axis=1).astype(np.int32)])
    e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
    tracemalloc.start()
    if method == "forces":
        layout._Mesh(135.0, 64, 1)(np.zeros((8, 3)))
        fixed = tracemalloc.get_traced_memory()[1]
        layout._forces(n, e, np.zeros(n), 1, 2)
    elif method == "mds":
        fixed = 5e6  # for pivots among each other and a block
        assert sum(len(x[2]) for x in layout._pivots(n, e, 1, rounds=2)) == 4 * n
    else:
        fixed = 20e6  # a block's candidates
        near, w = steps.linked_weights(*layout._adjacent(n, e), np.arange(n), 15, 1)
        dimred.embed_neighbours(n, 14, near.ravel(), w.ravel(), 3, 2, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (most - fixed) / n < 600


@pytest.mark.parametrize("hubs", [0, 3])
def test_neighbours_of_one_task_are_those_of_the_cluster(spark, hubs):
    """Others by steps, hubs' links cut alike, and the weights of their pairs."""
    from papyrine.operators import dimred, graph, layout, steps

    n, k, seed = 400, 6, 2
    e, ids = _linked_nodes(n, hubs), np.arange(n) * 7 - 900
    nodes = spark.createDataFrame([(int(i),) for i in ids], "node_id long")
    links = spark.createDataFrame([(int(ids[a]), int(ids[b])) for a, b in e], "src long, dst long")
    want = {tuple(r) for r in graph.hop_neighbours(links, nodes, k, seed).collect()}
    near, hops = steps.near_by_hops(*layout._adjacent(n, e), ids, k, seed, block=64)
    src, at = np.nonzero(near >= 0)
    assert want == set(zip(ids[src].tolist(), ids[near[src, at]].tolist(), hops[src, at].tolist(), strict=True))
    a, b, w = dimred.fuzzy_weights(n, src, near[src, at].astype(int), hops[src, at].astype(float), k + 1)
    near, weight = steps.linked_weights(*layout._adjacent(n, e), ids, k + 1, seed, block=64)
    src, at = np.nonzero(weight)
    got = {(min(s, d), max(s, d)): x for s, d, x in zip(src.tolist(), near[src, at].tolist(), weight[src, at].tolist(), strict=True)}
    want = {(s, d): x for s, d, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True) if np.float32(x)}
    assert len(got) == len(src) and got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-6) for p in got)


def test_places_around_pivots_are_in_blocks(spark):
    """A large component beside a small one, several blocks and layouts: each node once, pivots where they were laid out, as in one block."""
    from papyrine.operators import layout

    e = _linked_nodes(700, 1)
    nodes = spark.createDataFrame([(i, i / 700) for i in range(704)], "node_id long, t double")
    links = spark.createDataFrame([*map(tuple, e.tolist()), (701, 702)], "src long, dst long")
    jobs = [("mds", 1, {"iterations": 50}), ("umap-graph", 1, {"iterations": 50}), ("mds", 2, {"iterations": 50})]
    rows = layout.layouts(jobs, nodes, links, layout.components(nodes, links), most_in_task=300).toPandas()
    assert len(rows) == 3 * 704 and not rows.duplicated(["job", "node_id"]).any() and np.isfinite(rows[["x", "y", "z"]].to_numpy()).all()
    seed = 2 * 1_000_003
    found = list(layout._pivots(700, e, seed, rounds=50, block=1000))
    starts, at = found[0][4:]
    want = layout._around(np.concatenate([x[2] for x in found], axis=1), found[0][3], at, 50)
    want[starts] = at
    assert np.allclose(rows[(rows.job == 2) & (rows.node_id < 700)].sort_values("node_id")[["x", "y", "z"]], want)
    blocks = list(layout._pivots(700, e, seed, rounds=50, block=64))
    assert all((np.concatenate([x[k] for x in blocks if x[1] == 1]) == next(x[k] for x in found if x[1] == 1)).all() for k in (2, 3))


def test_sums_over_all_pairs(monkeypatch):
    """Repulsion and stress axis by axis, against their formulas."""
    from papyrine.operators import layout

    y = np.random.default_rng(1).normal(size=(300, 3))
    delta = y[:, None] - y[None]
    want = (delta / ((np.sqrt((delta**2).sum(-1)) + 1e-6) ** 2)[..., None]).sum(1)
    assert np.allclose(layout._repulsion(y), want)
    d = np.abs(np.subtract.outer(np.arange(300), np.arange(300))).astype(float)
    at = np.random.default_rng(5).normal(size=(300, 3)) * 299
    for _ in range(3):
        own = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
        b = -np.divide(d, own, out=np.zeros_like(own), where=own > 1e-12)
        np.fill_diagonal(b, -b.sum(1))
        at = b @ at / 300
    assert np.allclose(layout._smacof(d, 5, 3), at)


def test_exact_layouts_of_three_thousand_nodes_are_quick():
    """The largest components that all pairs are summed up for: under a fifth of a second a round, which whole tables of differences take over."""
    from time import perf_counter

    from papyrine.operators import layout

    y, took = np.random.default_rng(2).normal(size=(2800, 3)) * 30, []
    for _ in range(3):
        began = perf_counter()
        layout._repulsion(y)
        took.append(perf_counter() - began)
    assert min(took) < 0.2


def test_one_level_groups_only_its_own_rows(spark, small):
    """The rows of other levels are gone before assignments are grouped; the result is what all of them leave for the level."""
    from pyspark.sql import functions as F

    from papyrine.plans.tables import Domain

    dom = Domain(spark, small)
    got = dom.level(2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")
    uid = dom.levels.filter("level_no = 2").first()["level_uid"]
    want = dom.assign.filter(F.col("level_uid") == uid).select("node_id", "node_cluster")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_comparison_works_clusters_out_once(spark):
    """Rows come by an accumulator each time the clusters are worked out: once for the table and the nodes together."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pre = spark.createDataFrame([(i, i % 3) for i in range(60)], "node_id long, node_cluster int")
    post = spark.createDataFrame([(i, i % 4) for i in range(60)], "node_id long, node_cluster int")
    assert comparison.compare(pre.mapInArrow(count, pre.schema), post).nodes.count() == 60 and seen.value == 60


def test_records_are_put_together_for_top_movers_only(spark, small):
    """The cart meets the twenty nodes before its records are made and grouped."""
    plan = catalog.queries()["b6_top_mover_records"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.rindex("Aggregate") < plan.rindex("LeftSemi")


def test_bridges_by_chance_are_those_of_each_linking(spark, monkeypatch):
    """Random linkings smoothed and clustered together: as they come out one after the other, with a single smoothing for all of them."""
    from papyrine.operators import clustering, ghosts, instrumentation

    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i * 5, i >= 24, rng.normal(size=3).tolist() if i < 24 else None) for i in range(28)], "node_id long, is_ghost boolean, base_pos array<double>")
    links = spark.createDataFrame([*((i * 5, (i * 7 + 3) % 24 * 5) for i in range(24)), *((g * 5, int(d) * 5) for g in range(24, 28) for d in rng.choice(24, 5, replace=False)), (120, 125)], "src long, dst long")
    vectors = nodes.filter("base_pos is not null").selectExpr("node_id", "base_pos as vec")
    label = lambda v: clustering.mutual_knn(v, "node_id", "vec", 3)
    runs = lambda v: clustering.mutual_knn(v, "node_id", "vec", 3, by="run")
    g = nodes.filter("is_ghost").select("node_id")
    plain, pairs, want = links.filter("src < 120 and dst < 120"), ghosts.bridged_pairs(nodes, links), []
    for t in range(2):
        again = plain.unionByName(ghosts.rewire(nodes, links, 12345 + 7919 * t))
        fused = instrumentation.cut(instrumentation.diffuse(vectors, again, 0.3, 4, ghosts=g))
        want.append(instrumentation.pair_signal(pairs, fused, label(fused.join(g, "node_id", "left_anti"))).first())
    calls, diffuse = [], instrumentation.diffuse
    monkeypatch.setattr(instrumentation, "diffuse", lambda *a, **k: (calls.append(1), diffuse(*a, **k))[1])
    got = instrumentation.bridge_signal(nodes, links, vectors, label, nulls=2, label_runs=runs).first()
    assert got["pairs"] == want[0]["pairs"] > 0 and len(calls) == 2
    assert got["null_dist"] == pytest.approx((want[0]["mean_dist"] + want[1]["mean_dist"]) / 2)
    assert got["null_together"] == pytest.approx((want[0]["together"] + want[1]["together"]) / 2)


def test_level_pairs_without_a_join_of_all_assignments(spark, small):
    """The one join left is that with the handful of levels; counts are those of the join by nodes."""
    from pyspark.sql import functions as F

    from papyrine.plans.analysis_queries import _level_tables
    from papyrine.plans.tables import Domain

    dom = Domain(spark, small)
    got = _level_tables(dom)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    a = dom.assign.join(dom.levels.select("level_uid", "level_no"), "level_uid")
    x, y = (a.select("node_id", F.col("level_no").alias(f"{w}_level"), F.col("node_cluster").alias(c)) for w, c in (("first", "a"), ("second", "b")))
    want = x.join(y, "node_id").filter("first_level < second_level").groupBy("first_level", "second_level", "a", "b").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
