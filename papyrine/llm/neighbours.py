"""The k nearest vectors of every vector, by multiprobe p-stable hashing.

1. Rows of one position are cut to its k + 1 smallest identifiers, so that no position, however often repeated, fills a block.
2. A k-d tree over a sample of positions, ``per_leaf`` of them a block at least (it only balances the blocks), gives blocks of about ``block_rows`` rows.

Exact, the way for up to three dimensions (``exact=True``):

3. In a block every table hashes positions by floor(R x / w + b) with Gaussian directions made orthogonal within the table.
   A query visits the perturbed buckets in the order of their estimated success (squared distance to the bucket, which for
   orthogonal directions is also a lower bound); the candidates of all tables are merged and reranked by exact distance. Buckets
   that may still hold a nearer row follow until none is left, with w doubled for queries whose neighbours lie further than
   the perturbed buckets reach.
4. A query whose k-th distance passes its block's border goes down the tree with its ball, in a second round, to the blocks the ball meets.

Approximate, the way for more dimensions (``exact=False``), where a ball meets nearly every block:

5. Every table has directions of its own (``directions`` Gaussian ones, made orthogonal) and a tree over the projected positions, whose splits are the borders of its hash buckets.
   A query visits its bucket and the ``probes`` buckets behind the borders it is nearest to, in the order of estimated success (distance to the border crossed);
   within a bucket all rows are compared by exact distance in all dimensions, and the candidates of all tables and probes are merged. Work is proportional to
   rows x tables x (probes + 1) x ``bucket_rows``.
6. Recall is measured: ``asked`` queries, picked by a hash, are compared with all rows. Below ``recall`` as many tables again are added, ``rounds`` times at most; if that doesn't do, the exact way is taken.

Memory is bounded by a block. The driver holds the sample: ``per_leaf`` / ``block_rows`` of the rows (1 / 512), and executors the tree, one split a block.

Defined results: rows whose vector is null, has another length than ``dims`` or isn't finite take no part. Of equally near rows
the smaller identifier goes first; a row isn't its own neighbour, a repeated position is (at distance 0). Identifiers must be unique.
With fewer than k other rows the lists are shorter. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import cut, exact

_PAIRS = 3_000_000  # candidate pairs held at once


class KdTree:
    """Splits of a k-d tree with 2**depth leaves, from a sample of positions."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dims = sample.shape[1] if sample.size else 1
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        n = 2**self.depth
        self.axis, self.at = np.zeros(n, dtype=np.int32), np.full(n, np.inf)
        parts = {1: sample}
        for node in range(1, n):
            x = parts.pop(node)
            if len(x):
                a = int(np.argmax(x.max(0) - x.min(0)))
                s = float(np.median(x[:, a]))
                self.axis[node], self.at[node] = a, s
                left = x[:, a] < s
                parts[2 * node], parts[2 * node + 1] = x[left], x[~left]
            else:
                parts[2 * node] = parts[2 * node + 1] = x

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - 2**self.depth

    def reach(self, x: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: every leaf that the ball around a row, of squared radius ``r2``, may meet; all rows go down the tree together."""
        row, node, off = np.arange(len(x)), np.ones(len(x), dtype=np.int64), np.zeros((len(x), self.dims))
        for _ in range(self.depth):
            a = self.axis[node]
            gap = x[row, a] - self.at[node]
            right = gap >= 0
            far = off.copy()
            far[np.arange(len(row)), a] = np.maximum(far[np.arange(len(row)), a], np.abs(gap))  # distance to the far side, axis by axis
            over = np.isfinite(gap) & ((far**2).sum(1) <= r2[row])
            node = 2 * node
            row, node, off = np.concatenate([row, row[over]]), np.concatenate([node + right, node[over] + ~right[over]]), np.concatenate([off, far[over]])
        return row, node - 2**self.depth

    def probes(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: for each row up to ``most`` leaves besides its own, those behind the splits it is nearest to, nearest first."""
        path, node = [], np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            path.append(node)
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        if not path:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        nodes = np.stack(path, 1)
        gaps = np.abs(np.take_along_axis(x, self.axis[nodes], 1) - self.at[nodes])
        best = np.argsort(gaps, axis=1, kind="stable")[:, :most]
        row = np.repeat(np.arange(len(x)), best.shape[1])
        level = best.ravel()
        row, level = row[np.isfinite(gaps[row, level])], level[np.isfinite(gaps[row, level])]
        at = nodes[row, level]
        at = 2 * at + (x[row, self.axis[at]] < self.at[at])  # over to the other side
        for step in range(self.depth - 1):
            down = level + 1 + step < self.depth
            at = np.where(down, 2 * at + (x[row, self.axis[np.where(down, at, 1)]] >= self.at[np.where(down, at, 1)]), at)
        return row, at - 2**self.depth

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the leaves' regions; outer sides are infinite."""
        n = 2**self.depth
        lo, hi = np.full((2 * n, self.dims), -np.inf), np.full((2 * n, self.dims), np.inf)
        for node in range(1, n):
            for child in (2 * node, 2 * node + 1):
                lo[child], hi[child] = lo[node], hi[node]
            hi[2 * node, self.axis[node]] = min(hi[node, self.axis[node]], self.at[node])
            lo[2 * node + 1, self.axis[node]] = max(lo[node, self.axis[node]], self.at[node])
        return lo[n:], hi[n:]


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices [start, end): the slice and the position of each element."""
    counts = ends - starts
    which = np.repeat(np.arange(len(starts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return which, starts[which] + np.arange(len(which)) - first


class _Tables:
    """Hash tables of a block's rows at one bucket width."""

    def __init__(self, projected: list[np.ndarray], offsets: list[np.ndarray], w: float):
        self.w, self.tables = w, []
        for y, b in zip(projected, offsets, strict=True):
            h = np.floor(y / w + b).astype(np.int64)
            lo, span = h.min(0), h.max(0) - h.min(0) + 1
            key = self.key(h, lo, span)
            order = np.argsort(key, kind="stable")
            self.tables.append((b, lo, span, key[order], order))

    @staticmethod
    def key(h: np.ndarray, lo: np.ndarray, span: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape[:-1], dtype=np.int64)
        for i in range(h.shape[-1]):
            out = out * span[i] + (h[..., i] - lo[i])
        return out

    def scores(self, t: int, y: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home buckets; the squared distance to every perturbed bucket; how far the perturbed buckets reach."""
        p = y / self.w + self.tables[t][0]
        home = np.floor(p)
        f = p - home
        gap = np.stack([f, np.zeros_like(f), 1 - f], axis=2) * self.w
        score = sum(gap[:, i, steps[:, i] + 1] ** 2 for i in range(y.shape[1]))
        return home.astype(np.int64), score, (1 + np.minimum(f, 1 - f).min(1)) * self.w

    def slices(self, t: int, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, lo, span, keys, _ = self.tables[t]
        ok = ((buckets >= lo) & (buckets < lo + span)).all(1)
        k = self.key(buckets[ok], lo, span)
        s, e = np.zeros(len(buckets), dtype=np.int64), np.zeros(len(buckets), dtype=np.int64)
        s[ok], e[ok] = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        return s, e

    def rows(self, t: int, at: np.ndarray) -> np.ndarray:
        return self.tables[t][4][at]


def _best(q: np.ndarray, d2: np.ndarray, ids: np.ndarray, rows: np.ndarray, nq: int, k: int):
    """The k nearest candidates of each query as matrices of distance and row."""
    order = np.lexsort((ids[rows], d2, q))
    q, d2, rows = q[order], d2[order], rows[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = rank < k
    dist, found = np.full((nq, k), np.inf), np.full((nq, k), -1, dtype=np.int64)
    dist[q[keep], rank[keep]], found[q[keep], rank[keep]] = d2[keep], rows[keep]
    return dist, found


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, radius2: np.ndarray, k: int, seed: int = 7, tables: int = 2, probes: int = 4):
    """Squared distances and rows of the k nearest of ``x`` to each query, as far as its squared radius."""
    nq, (n, d) = len(queries), x.shape
    dist, found = np.full((nq, k), np.inf), np.full((nq, k), -1, dtype=np.int64)
    if not n or not nq:
        return dist, found
    rng, m = np.random.default_rng(seed), min(d, 3)
    turns = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m] for _ in range(tables)]
    offsets = [rng.random(m) for _ in range(tables)]
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=m)))
    base, asked = [x @ r for r in turns], [queries @ r for r in turns]
    extent = np.ptp(base[0], axis=0).max()
    whole = np.ptp(np.concatenate([base[0], asked[0]]), axis=0).max()  # queries may lie outside
    w = (extent if extent > 0 else 1.0) * (3 / n) ** (1 / m)
    for _ in range(40):  # as fine as the dense parts need
        table = _Tables(base[:1], offsets[:1], w).tables[0]
        counts = np.unique(table[3], return_counts=True)[1]
        if np.quantile(np.repeat(counts, counts), 0.95) <= 4 * k or w < 1e-9 * max(extent, 1e-300):
            break
        w /= 2
    active = np.arange(nq)
    while len(active):
        t = _Tables(base, offsets, w)
        left, work = [], [active[i : i + 8192] for i in range(0, len(active), 8192)]
        everything = w > 4 * max(whole, 1e-300)
        while work:
            part = work.pop()
            sure = _probe(t, x, ids, queries, radius2, asked, part, steps, k, probes, dist, found, everything)
            if sure is None:
                work += [part[: len(part) // 2], part[len(part) // 2 :]]
            else:
                left.append(part[~sure])
        active = np.concatenate(left) if left else active[:0]
        w *= 2
    beyond = dist > radius2[:, None]
    dist[beyond], found[beyond] = np.inf, -1
    return dist, found


def _probe(t, x, ids, queries, radius2, asked, part, steps, k, probes, dist, found, everything):
    """Answers the queries of ``part`` at one width; which of them are certain. None: too many candidates at once."""
    qs, rs = [], []
    reach = None
    for j in range(len(asked)):
        home, score, far = t.scores(j, asked[j][part], steps)
        first = np.argsort(score, axis=1, kind="stable")[:, :probes]
        s, e = t.slices(j, (home[:, None, :] + steps[first]).reshape(-1, home.shape[1]))
        if (e - s).sum() > _PAIRS and len(part) > 1:
            return None
        which, at = _expand(s, e)
        qs.append(which // first.shape[1])
        rs.append(t.rows(j, at))
        if j == 0:
            home0, score0, first0, reach = home, score, first, far
    pair = np.unique(np.concatenate(qs) * len(x) + np.concatenate(rs))  # candidates of all tables, once each
    q, r = pair // len(x), pair % len(x)
    d2 = ((x[r] - queries[part][q]) ** 2).sum(1)
    near, rows = _best(q, d2, ids, r, len(part), k)
    need = np.minimum(near[:, -1], radius2[part])
    rest = score0 <= need[:, None]
    np.put_along_axis(rest, first0, False, axis=1)
    certain = (need < reach**2) | everything
    rest &= certain[:, None] & (np.isfinite(need)[:, None] | everything)
    rq, rp = np.nonzero(rest)
    s, e = t.slices(0, home0[rq] + steps[rp])
    if (e - s).sum() > _PAIRS and len(part) > 1:
        return None
    which, at = _expand(s, e)
    q2, r2 = rq[which], t.rows(0, at)
    if len(q2):
        d2 = ((x[r2] - queries[part][q2]) ** 2).sum(1)
        take = d2 <= need[q2]
        hq, hk = np.nonzero(rows >= 0)
        pair = np.unique(np.concatenate([hq * len(x) + rows[hq, hk], q2[take] * len(x) + r2[take]]))
        q, r = pair // len(x), pair % len(x)
        near, rows = _best(q, ((x[r] - queries[part][q]) ** 2).sum(1), ids, r, len(part), k)
    dist[part[certain]], found[part[certain]] = near[certain], rows[certain]
    return certain


def _columns(batch, dims: int) -> np.ndarray:
    return np.column_stack([batch.column(f"v{i}").to_numpy() for i in range(dims)]) if batch.num_rows else np.zeros((0, dims))


def usable(df: DataFrame, ident: str, vector: str, dims: int) -> DataFrame:
    """``(id, v0, v1, ...)`` of the rows with a usable vector."""
    v = F.col(f"`{vector}`")
    out = exact(df, ident, vector).select(F.col(f"`{ident}`").cast("long").alias("id"), *(F.get(v, F.lit(i)).cast("double").alias(f"v{i}") for i in range(dims)), F.size(v).alias("n"))
    for i in range(dims):
        c = F.col(f"v{i}")
        out = out.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return out.filter((F.col("n") == dims) & F.col("id").isNotNull()).select("id", *((F.col(f"v{i}") + F.lit(0.0)).alias(f"v{i}") for i in range(dims)))


class Neighbours:
    """What ``nearest`` found: ``base`` (id, v.., rn, leaf), ``lists`` (id, leaf, d2[], nid[]) with the position's own rows
    first, ``crowded`` positions (with more than k + 1 rows), ``depth`` of the tree of blocks."""

    def __init__(self, base: DataFrame, lists: DataFrame, crowded: DataFrame | None, k: int, dims: int, depth: int):
        self.base, self.lists, self.crowded, self.k, self.dims, self.depth = base, lists, crowded, k, dims, depth


def _sample(rows: DataFrame, vs: list[str], n: int, leaves: int, per_leaf: int, seed: int) -> np.ndarray:
    """Positions for a tree: all of few rows, else ``per_leaf`` for each leaf, 40,000 at least."""
    want = max(40_000, per_leaf * leaves)
    some = rows.select(*vs)
    if n > want:
        some = some.sample(min(1.0, want / n), seed)
    got = some.toArrow()
    return np.column_stack([got.column(v).to_numpy() for v in vs]).astype(float) if got.num_rows else np.zeros((0, len(vs)))


def _answer(vs: list[str], ids, q, leaf, dist, rows, base_ids, open_) -> pa.Table:
    nid = np.where(rows >= 0, base_ids[np.maximum(rows, 0)] if len(base_ids) else -1, -1)
    keep = rows >= 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]), pa.int32())
    cols = [pa.array(ids, pa.int64()), *(pa.array(q[:, i]) for i in range(len(vs))), pa.array(leaf, pa.int64())]
    cols += [pa.ListArray.from_arrays(offsets, pa.array(dist[keep])), pa.ListArray.from_arrays(offsets, pa.array(nid[keep], pa.int64())), pa.array(open_)]
    return pa.Table.from_arrays(cols, names=["id", *vs, "leaf", "d2", "nid", "open"])


def nearest(points: DataFrame, k: int, dims: int, block_rows: int = 16384, per_leaf: int = 32, seed: int = 7, exact: bool | None = None, **approximate) -> Neighbours:
    """For each distinct position of ``points`` (from ``usable``) the k + 1 nearest rows, its own among them.

    ``exact`` is the rule up to three dimensions; beyond, ``approximate`` takes ``tables``, ``probes``, ``directions``, ``bucket_rows``, ``recall``, ``asked`` and ``rounds``.
    """
    vs = [f"v{i}" for i in range(dims)]
    k1 = k + 1
    w = Window.partitionBy(*vs).orderBy("id")
    ranked = cut(points.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k1 + 1))
    n = ranked.count()
    crowded = ranked.filter(F.col("rn") == k1 + 1).select(*vs)
    crowded = None if crowded.isEmpty() else crowded
    if not (dims <= 3 if exact is None else exact):
        base, lists = _approximate(ranked.filter(F.col("rn") <= k1).select("id", *vs, "rn"), k1, dims, n, per_leaf, seed, **approximate)
        if lists is not None:
            return Neighbours(base, lists, crowded, k, dims, 0)
    leaves = -(-n // block_rows)
    tree = KdTree(_sample(ranked, vs, n, leaves, per_leaf, seed), leaves)
    names = ["id", *vs, "rn"]

    def with_leaf(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(tree.leaf(_columns(b, dims)), pa.int64())], names=[*names, "leaf"])

    base = ranked.filter(F.col("rn") <= k1).select(*names).mapInArrow(with_leaf, ", ".join(["id long", *(f"{v} double" for v in vs), "rn int", "leaf long"]))
    lo, hi = tree.regions()
    found_schema = ", ".join(["id long", *(f"{v} double" for v in vs), "leaf long", "d2 array<double>", "nid array<long>", "open double"])

    def inside(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        x, ids, leaf = _columns(tab, dims), tab.column("id").to_numpy(), int(tab.column("leaf")[0].as_py())
        ask = tab.column("rn").to_numpy() == 1
        q = x[ask]
        dist, rows = search(x, ids, q, np.full(len(q), np.inf), k1, seed)
        border = np.minimum(q - lo[leaf], hi[leaf] - q).min(1) if len(q) else np.zeros(0)
        open_ = np.where(dist[:, -1] < border**2, -1.0, dist[:, -1])
        if tree.depth == 0:
            open_[:] = -1.0
        return _answer(vs, ids[ask], q, np.full(len(q), leaf), dist, rows, ids, open_)

    first = base.groupBy("leaf").applyInArrow(inside, found_schema)
    if tree.depth == 0:
        return Neighbours(base, cut(first.select("id", "leaf", "d2", "nid")), crowded, k, dims, tree.depth)
    first = cut(first)
    qnames = ["id", *vs, "leaf", "open"]

    def route(batches):
        for b in batches:
            q, own, r2, ids = _columns(b, dims), b.column("leaf").to_numpy(), b.column("open").to_numpy(), b.column("id").to_numpy()
            for s in range(0, len(q), 2048):
                part = q[s : s + 2048]
                qi, li = tree.reach(part, r2[s : s + 2048])
                other = li != own[s : s + 2048][qi]
                qi, li = qi[other], li[other]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 2048][qi]), *(pa.array(part[qi, i]) for i in range(dims)), pa.array(li), pa.array(r2[s : s + 2048][qi])], names=qnames)

    asked = first.filter(F.col("open") >= 0).select(*qnames).mapInArrow(route, ", ".join(["id long", *(f"{v} double" for v in vs), "leaf long", "open double"]))
    both = base.select("id", *vs, "leaf", F.lit(-1.0).alias("open")).unionByName(asked)

    def outside(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        x, ids, open_ = _columns(tab, dims), tab.column("id").to_numpy(), tab.column("open").to_numpy()
        ask = open_ >= 0
        dist, rows = search(x[~ask], ids[~ask], x[ask], open_[ask], k1, seed)
        some = rows[:, 0] >= 0
        return _answer(vs, ids[ask][some], x[ask][some], tab.column("leaf").to_numpy()[ask][some], dist[some], rows[some], ids[~ask], open_[ask][some])

    second = both.groupBy("leaf").applyInArrow(outside, found_schema)
    pairs = F.arrays_zip("d2", "nid").alias("p")
    more = first.filter(F.col("open") >= 0).select("id", "leaf", pairs).unionByName(second.select("id", F.lit(-1).cast("long").alias("leaf"), pairs))
    merged = more.groupBy("id").agg(F.max("leaf").alias("leaf"), F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k1).alias("p")).select("id", "leaf", F.col("p.d2").alias("d2"), F.col("p.nid").alias("nid"))
    lists = cut(first.filter(F.col("open") < 0).select("id", "leaf", "d2", "nid").unionByName(merged))
    return Neighbours(base, lists, crowded, k, dims, tree.depth)


def _nearest_in(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of ``x`` to each query by comparing all, some hundred queries at a time; distances of those kept are computed again without cancellation."""
    order = np.argsort(ids, kind="stable")
    x, m = x[order], min(k, len(x))
    square, dist, found = (x**2).sum(1), np.full((len(q), k), np.inf), np.full((len(q), k), -1, dtype=np.int64)
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        d = square - 2 * part @ x.T
        near = np.argpartition(d, m - 1, axis=1)[:, : min(len(x), m + 8)] if m < len(x) else np.broadcast_to(np.arange(len(x)), d.shape)
        if near.shape[1] < min(len(x), m + 8):
            near = np.argsort(d, axis=1)[:, : m + 8]
        near = np.sort(near, axis=1)
        exact = ((x[near] - part[:, None, :]) ** 2).sum(2)
        best = np.argsort(exact, axis=1, kind="stable")[:, :m]
        dist[s : s + 512, :m], found[s : s + 512, :m] = np.take_along_axis(exact, best, 1), order[np.take_along_axis(near, best, 1)]
    return dist, found


def recall_of(base: DataFrame, lists: DataFrame, vs: list[str], k1: int, asked: int, seed: int) -> float:
    """The share of the true neighbours of ``asked`` queries that their lists hold; the queries, a bounded set, are compared with all rows batch by batch."""
    some = base.filter("rn = 1").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked).select("id", *vs).toArrow().combine_chunks()
    if not some.num_rows:
        return 1.0
    qid, q = some.column("id").to_numpy(), np.column_stack([some.column(v).to_numpy() for v in vs])

    def compare(batches):
        for b in batches:
            if b.num_rows:
                dist, rows = _nearest_in(_columns(b, len(vs)), b.column("id").to_numpy(), q, k1)
                yield from _answer(vs, qid, q, np.zeros(len(q)), dist, rows, b.column("id").to_numpy(), np.zeros(len(q))).select(["id", "d2", "nid"]).to_batches()

    near = base.select("id", *vs).mapInArrow(compare, "id long, d2 array<double>, nid array<long>").groupBy("id").agg(_merged(k1).alias("p"))
    j = near.select("id", F.array_except(F.col("p.nid"), F.array("id")).alias("true")).join(lists.select("id", F.col("nid").alias("got")), "id", "left")
    share = j.agg(F.sum(F.size(F.array_intersect("true", F.coalesce("got", F.array().cast("array<bigint>"))))) / F.sum(F.size("true"))).first()[0]
    return 1.0 if share is None else float(share)


def _merged(k1: int):
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("d2", "nid"))))), 1, k1)


def _approximate(base: DataFrame, k1: int, dims: int, n: int, per_leaf: int, seed: int, tables: int = 6, probes: int = 3, directions: int = 16, bucket_rows: int = 2048, recall: float = 0.9, asked: int = 256, rounds: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """``base`` and the lists found by tables of hash buckets; None if they don't reach the recall."""
    vs, leaves, m = [f"v{i}" for i in range(dims)], -(-n // bucket_rows), min(dims, directions)
    x = _sample(base, vs, n, leaves, per_leaf, seed)
    schema = ", ".join(["tab int", "leaf long", "id long", *(f"{v} double" for v in vs), "ask boolean", "home boolean"])
    names = [c.split()[0] for c in schema.split(", ")]

    def pass_of(number: int) -> DataFrame:
        rng = np.random.default_rng((seed, number))
        turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :m] for _ in range(tables)]
        trees = [KdTree(x @ r, leaves) for r in turns]

        def hashed(batches):
            for b in batches:
                x, ids, ask = _columns(b, dims), b.column("id").to_numpy(), b.column("rn").to_numpy() == 1
                for t, (r, tree) in enumerate(zip(turns, trees, strict=True)):
                    y = x @ r
                    row, leaf = tree.probes(y[ask], probes)
                    row = np.concatenate([np.arange(len(x)), np.flatnonzero(ask)[row]])
                    leaf = np.concatenate([tree.leaf(y), leaf])
                    home = np.arange(len(row)) < len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, dtype=np.int32)), pa.array(leaf), pa.array(ids[row]), *(pa.array(x[row, i]) for i in range(dims)), pa.array(ask[row]), pa.array(home)], names=names)

        def compare(tab: pa.Table) -> pa.Table:
            tab = tab.combine_chunks()
            x, ids, ask, home = _columns(tab, dims), tab.column("id").to_numpy(), tab.column("ask").to_numpy(zero_copy_only=False), tab.column("home").to_numpy(zero_copy_only=False)
            dist, rows = _nearest_in(x[home], ids[home], x[ask], k1) if home.any() else (np.full((int(ask.sum()), k1), np.inf), np.full((int(ask.sum()), k1), -1, dtype=np.int64))
            out = _answer(vs, ids[ask], x[ask], np.zeros(int(ask.sum())), dist, rows, ids[home], np.zeros(int(ask.sum())))
            return out.select(["id", "d2", "nid"])

        return base.mapInArrow(hashed, schema).groupBy("tab", "leaf").applyInArrow(compare, "id long, d2 array<double>, nid array<long>")

    lists = None
    for number in range(1 + rounds):
        found = pass_of(number) if lists is None else pass_of(number).unionByName(lists.select("id", "d2", "nid"))
        lists = cut(found.groupBy("id").agg(_merged(k1).alias("p")).select("id", F.lit(0).cast("long").alias("leaf"), F.col("p.d2").alias("d2"), F.col("p.nid").alias("nid")))
        if recall_of(base, lists, vs, k1, asked, seed) >= recall:
            return base.withColumn("leaf", F.lit(0).cast("long")), lists
    return base, None


def of_every_row(points: DataFrame, found: Neighbours) -> DataFrame:
    """``(id, rank, nid, d2)``: the k nearest of every row, repeated positions included."""
    k, vs = found.k, [f"v{i}" for i in range(found.dims)]
    p = found.lists.select(F.arrays_zip("d2", "nid").alias("p"))
    same = F.expr("filter(p, e -> e.d2 = 0)")
    each = p.select("p", F.explode(same).alias("s")).select(F.col("s.nid").alias("id"), F.expr(f"slice(filter(p, e -> e.nid <> s.nid), 1, {k})").alias("p"))
    if found.crowded is not None:
        first = found.base.join(found.crowded, vs).groupBy(*vs).agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 rows each
        rows = points.join(first, vs).filter(~F.array_contains("ids", F.col("id")))
        each = each.unionByName(rows.select("id", F.expr(f"transform(slice(ids, 1, {k}), e -> named_struct('d2', 0D, 'nid', e))").alias("p")))
    return each.select("id", F.posexplode("p").alias("rank", "e")).select("id", (F.col("rank") + 1).alias("rank"), F.col("e.nid").alias("nid"), F.col("e.d2").alias("d2"))


def pairs(points: DataFrame, found: Neighbours) -> DataFrame:
    """``(node_a, node_b)``: pairs of which one is among the nearest of the other."""
    e = of_every_row(points, found)
    return e.select(F.least("id", "nid").alias("node_a"), F.greatest("id", "nid").alias("node_b")).distinct()
