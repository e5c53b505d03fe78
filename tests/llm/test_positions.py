import numpy as np
import pytest

from papyrine.llm import density, neighbours


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def brute(x, ids, k):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        out[ids[i]] = [ids[j] for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], ids[j]))[:k]]
    return out


def lists(points, found):
    got = {}
    for r in neighbours.of_every_row(points, found).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["nid"])
    return got


@pytest.mark.parametrize("block", [16384, 60])
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_against_brute_force(spark, block, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(150, dims)), rng.normal(size=(100, dims)) * 0.01 + 4, rng.uniform(-50, 50, (60, dims)), np.full((1, dims), 1e6)]).round(3)
    x[:9] = x[0]  # one position nine times, another twice
    x[20] = x[21]
    p = neighbours.usable(frame(spark, x), "id", "v", dims)
    got, want = lists(p, neighbours.nearest(p, 5, dims, block_rows=block)), brute(x, list(range(len(x))), 5)
    assert got == want  # recall 1, where 0.9 would do


@pytest.mark.parametrize("dims", [16, 64])
def test_nearest_of_many_dimensions(spark, dims):
    """Recall of at least 0.9 by the production parameters, over buckets of which a query sees a few only."""
    rng = np.random.default_rng(dims)
    n = 6000
    x = rng.normal(size=(40, dims))[rng.integers(0, 40, n)] * 0.6 + rng.normal(size=(n, dims)) * rng.uniform(0.2, 1.0, (n, 1)) * 0.3
    x[:7] = x[0]
    p = neighbours.usable(frame(spark, x), "id", "v", dims)
    got = lists(p, neighbours.nearest(p, 5, dims, bucket_rows=256))
    asked = range(0, n, 50)
    hits = 0
    for i in asked:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:5].tolist()) & set(got[i]))
    assert hits / (5 * len(asked)) >= 0.9
    assert got[0] == [1, 2, 3, 4, 5] and all(len(v) == 5 and i not in v for i, v in got.items())


@pytest.mark.parametrize("rounds", [8, 0])
def test_tables_are_added_until_recall_is_reached(spark, rounds):
    """Vectors without any structure: one table of narrow buckets doesn't do; more tables do, or else the exact way."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24))
    p = neighbours.usable(frame(spark, x), "id", "v", 24)
    got = lists(p, neighbours.nearest(p, 5, 24, tables=4, probes=2, bucket_rows=100, rounds=rounds, recall=0.9 if rounds else 1.01))
    want = brute(x, list(range(len(x))), 5)
    share = np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want])
    assert share >= (0.88 if rounds else 1.0)


def test_tree_descent():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    tree = neighbours.KdTree(x, 64)
    lo, hi = tree.regions()
    q, r2 = rng.normal(size=(50, 3)), rng.uniform(0, 1, 50) ** 2
    gap = (np.maximum(0, np.maximum(lo[None] - q[:, None], q[:, None] - hi[None])) ** 2).sum(2)
    assert sorted(zip(*(a.tolist() for a in tree.reach(q, r2)), strict=True)) == sorted(zip(*(a.tolist() for a in np.nonzero(gap <= r2[:, None])), strict=True))
    row, leaf = tree.probes(q, 3)
    assert len(set(zip(row.tolist(), leaf.tolist(), strict=True))) == 150 and not (leaf == tree.leaf(q)[row]).any()


def test_nearest_skips_unusable_rows(spark):
    rows = [(1, [0.0, 0.0, 0.0], "a"), (2, [1.0, 0.0, 0.0], "b"), (3, None, "c"), (4, [1.0, 2.0], "d"), (5, [float("nan"), 0.0, 0.0], "e"), (6, [float("inf"), 0.0, 0.0], "f"), (7, [None, 0.0, 0.0], "g"), (8, [0.0, 0.0, 0.0, 0.0], "h"), (None, [0.0, 0.0, 0.0], "i")]
    df = spark.createDataFrame(rows, "id long, v array<double>, leaf string")
    p = neighbours.usable(df, "id", "v", 3)
    assert lists(p, neighbours.nearest(p, 5, 3)) == {1: [2], 2: [1]}


def test_nearest_of_little(spark):
    for x in ([], [[1.0, 2, 3]]):
        p = neighbours.usable(frame(spark, x), "id", "v", 3)
        assert neighbours.pairs(p, neighbours.nearest(p, 5, 3)).count() == 0


def test_nearest_all_at_one_place(spark):
    p = neighbours.usable(frame(spark, np.zeros((500, 3))), "id", "v", 3)
    got = lists(p, neighbours.nearest(p, 5, 3, block_rows=50))
    assert got[0] == [1, 2, 3, 4, 5] and got[499] == [0, 1, 2, 3, 4] and len(got) == 500


def groups(seed=0):
    rng = np.random.default_rng(seed)
    ring = rng.uniform(0, 2 * np.pi, 120)
    parts = [rng.normal(size=(80, 3)) * 0.3, rng.normal(size=(40, 3)) * 0.1 + [20, 0, 0], np.stack([6 * np.cos(ring), 6 * np.sin(ring), rng.normal(size=120) * 0.1], 1) + [0, 40, 0], rng.normal(size=(12, 3)) * 0.2 + [-25, -25, 5]]
    x = np.concatenate([*parts, rng.uniform(-60, 60, (40, 3))])
    truth = np.repeat([0, 1, 2, 3, -1], [80, 40, 120, 12, 40])
    order = rng.permutation(len(x))
    return x[order], truth[order]


@pytest.mark.parametrize("block", [16384, 100, 40])
def test_density_groups(spark, block):
    x, truth = groups()
    p = neighbours.usable(frame(spark, x), "id", "v", 3)
    rows = density.cluster(p, 3, block_rows=block)
    got = {}
    for r in rows.collect():
        got.setdefault(r["cluster"], set()).add(r["node_id"])
    want = [set(np.flatnonzero(truth == g).tolist()) for g in range(4)]
    assert len(got) == 4
    for w in want:
        best = max(got.values(), key=lambda g: len(g & w))
        assert len(best & w) / len(best | w) > 0.9
    assert all(c == min(m) for c, m in got.items())
    pairs = {tuple(r) for r in density.chain(rows, bucket=16).collect()}
    assert pairs == {(a, b) for m in got.values() for a, b in zip(sorted(m), sorted(m)[1:], strict=False)}
    s = {r["cluster"]: r for r in density.summaries(rows).collect()}
    assert all(s[c]["size"] == len(m) and len(s[c]["exemplars"]) == 3 and set(s[c]["exemplars"]) <= m for c, m in got.items())


def test_density_in_blocks_is_the_same(spark):
    x, _ = groups(3)
    p = neighbours.usable(frame(spark, x), "id", "v", 3)
    results = [sorted(map(tuple, density.cluster(p, 3, block_rows=b).select("cluster", "node_id").collect())) for b in (16384, 120, 50)]
    assert results[0] == results[1] == results[2]


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    p = neighbours.usable(frame(spark, x), "id", "v", 3)
    found = neighbours.nearest(p, 6, 3, block_rows=40)
    half = density.reach_edges(found, 3).toPandas()
    got = density.spanning_forest(density.reach_edges(found, 3), found.depth).toPandas()
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    total = n = 0
    for r in half.sort_values("w").itertuples():
        a, b = find(r.u), find(r.v)
        if a != b:
            parent[a] = b
            total, n = total + r.w, n + 1
    assert len(got) == n and got.w.sum() == pytest.approx(total)


def test_density_of_little_and_of_copies(spark):
    for x in (np.zeros((0, 3)), np.zeros((5, 3))):
        p = neighbours.usable(frame(spark, x), "id", "v", 3)
        assert density.cluster(p, 3).count() == 0
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((60, 3)), rng.normal(size=(30, 3)) * 0.1 + 9, rng.uniform(-50, 50, (30, 3))])
    p = neighbours.usable(frame(spark, x), "id", "v", 3)
    got = density.cluster(p, 3).groupBy("cluster").count().toPandas()
    assert 60 in got["count"].tolist()
