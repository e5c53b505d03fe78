"""Exact nearest neighbours in up to three dimensions, group by group: small groups share tasks, large ones are divided by a tree of splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.graph import connected_components
from papyrine.session import cut

_PAIRS = 2_000_000  # candidate pairs held at once
_FOUND = "src long, dst long, d2 double"


class Splits:
    """Halvings of space, each along the widest axis of a sample's part, down to ``leaves`` regions at least; a repeated position stays in one region."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        n = 2**self.depth
        self.axis, self.at = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
        parts = {1: sample}
        for node in range(1, n):
            x = parts.pop(node)
            if len(x):
                self.axis[node] = np.argmax(x.max(0) - x.min(0))
                self.at[node] = np.median(x[:, self.axis[node]])
            right = x[:, self.axis[node]] >= self.at[node]
            parts[2 * node], parts[2 * node + 1] = x[~right], x[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - 2**self.depth

    def reach(self, x: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and regions: every region that the ball around a row, of squared radius ``r2``, may meet."""
        row, node, off = np.arange(len(x)), np.ones(len(x), dtype=np.int64), np.zeros(x.shape)
        for _ in range(self.depth):
            a = self.axis[node]
            gap = x[row, a] - self.at[node]
            far, own = off.copy(), np.arange(len(row))
            far[own, a] = np.maximum(far[own, a], np.abs(gap))
            over = np.isfinite(gap) & ((far**2).sum(1) <= r2[row])
            right, node = gap >= 0, 2 * node
            row, node, off = np.concatenate([row, row[over]]), np.concatenate([node + right, node[over] + ~right[over]]), np.concatenate([off, far[over]])
        return row, node - 2**self.depth


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, axis by axis in the order in which they are written down."""
    out = (a[..., 0] - b[..., 0]) ** 2
    for c in range(1, a.shape[-1]):
        out = out + (a[..., c] - b[..., c]) ** 2
    return out


class _Tree:
    """A balanced tree over rows: boxes around equal parts, each halved along its widest axis."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, width: int):
        n, dims = x.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / width)))))
        self.width = int(np.ceil(n / 2**self.depth))
        size = self.width * 2**self.depth
        order = np.concatenate([np.arange(n), np.full(size - n, n)])  # n: no row
        y = np.vstack([x, np.full((1, dims), np.inf)])
        for level in range(self.depth):
            order = order.reshape(2**level, -1)
            p = y[order]
            spread = np.where(np.isfinite(p), p, -np.inf).max(1) - p.min(1)
            key = np.take_along_axis(p, np.argmax(np.nan_to_num(spread, nan=-np.inf), 1)[:, None, None], 2)[:, :, 0]
            order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), 1)
        order = order.reshape(-1, self.width)
        self.x, self.ids, self.none = y[order], np.append(ids, 0)[order], order == n
        self.home = np.empty(n + 1, dtype=np.int64)
        self.home[order] = np.arange(len(order))[:, None]
        low, high = self.x.min(1), np.where(self.none[:, :, None], -np.inf, self.x).max(1)
        self.boxes = [(low, high)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.append((low, high))
        self.boxes.reverse()

    def bounds(self, q: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
        """The squared distance within which k rows lie for sure: that of the k-th of a leaf."""
        out = np.full(len(q), np.inf)
        if self.width >= k:
            for s in range(0, len(q), max(1, _PAIRS // self.width)):
                e = slice(s, s + max(1, _PAIRS // self.width))
                out[e] = np.partition(_squares(q[e][:, None], self.x[leaf[e]]), k - 1, axis=1)[:, k - 1]
        return out

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the k nearest rows within ``bound``, by rounded distance and identifier: query, identifier, distance."""
        out, slack = [], 2 * 10.0**-digits  # rows that rounding makes equal
        bound = bound * (1 + 1e-12) + slack
        step = 4096
        for s in range(0, len(q), step):
            row, node = np.arange(s, min(s + step, len(q))), np.zeros(min(step, len(q) - s), dtype=np.int64)
            for level, (low, high) in enumerate(self.boxes):
                if level:
                    row, node = np.repeat(row, 2), (2 * node[:, None] + np.arange(2)).ravel()
                gap = np.maximum(np.maximum(low[node] - q[row], q[row] - high[node]), 0)
                near = (gap**2).sum(1) <= bound[row]
                row, node = row[near], node[near]
            best = []
            for t in range(0, len(row), max(1, _PAIRS // self.width)):
                r, leaf = row[t : t + max(1, _PAIRS // self.width)], node[t : t + max(1, _PAIRS // self.width)]
                d = _squares(q[r][:, None], self.x[leaf])
                i, j = np.nonzero((d <= bound[r][:, None]) & ~self.none[leaf])
                best.append(_first(r[i], self.ids[leaf[i], j], d[i, j].round(digits), k))
            if best:
                out.append(_first(*(np.concatenate(c) for c in zip(*best, strict=True)), k))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _first(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], d[rank < k]


def _places(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place (from 0) of each row, equal positions sharing one, and the rows with the k + 1 smallest identifiers of each: no others can be among k nearest."""
    order = np.lexsort((ids, *x.T))
    new = np.append(True, (x[order][1:] != x[order][:-1]).any(1)) if len(x) else np.zeros(0, dtype=bool)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    rank = np.arange(len(x)) - first[place[order]] if len(x) else first
    return place, order[rank <= k]


def nearest(x: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its k nearest others: identifiers of both, and the rounded squared distance."""
    n = len(x)
    if n <= 96:
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        d = _squares(x[:, None], x[None]).round(digits)
        d[ids[:, None] == ids[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        ok = np.isfinite(dist)
        return np.repeat(ids, near.shape[1])[ok.ravel()], ids[near][ok], dist[ok]
    place, kept = _places(x, ids, k)
    tree = _Tree(x[kept], ids[kept], max(16, k + 1))
    count = int(place.max()) + 1
    one = np.zeros(count, dtype=np.int64)
    one[place[kept]] = np.arange(len(kept))  # a row of each place
    by = np.argsort(tree.home[one], kind="stable")  # neighbours in space together
    q = x[kept][one[by]]
    at, dst, d = tree.search(q, tree.bounds(q, tree.home[one[by]], k + 1), k + 1, digits)
    at = by[at]
    order = np.argsort(at, kind="stable")
    at, dst, d = at[order], dst[order], d[order]
    first, last = np.searchsorted(at, place), np.searchsorted(at, place, side="right")
    row = np.repeat(np.arange(n), last - first)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
    other = ids[row] != dst[pos]
    row, pos = row[other], pos[other]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, pos = row[rank < k], pos[rank < k]
    return ids[row], dst[pos], d[pos]


def _divisions(rows: DataFrame, names: list[str], block_rows: int) -> tuple[int, dict, dict]:
    """Of ``(id, grp, *names)``: the number of tasks for groups that stay whole; the splits and the first task of each group of over ``block_rows`` rows."""
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    large = {r["grp"]: r["n"] for r in sizes.filter(F.col("n") > block_rows).collect()}  # under one a block of rows
    tasks = (sizes.agg(F.sum("n")).first()[0] or 0) // block_rows + 1
    trees, begin = {}, {}
    if large:
        big = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(g, 32.0 / block_rows) for g in large], f"grp {rows.schema['grp'].dataType.simpleString()}, share double")), "grp")
        unit = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        sample = big.filter(unit < F.greatest("share", F.lit(64.0) / F.lit(float(min(large.values()))))).select("grp", *names).toPandas()
        upto = tasks
        for g, n in sorted(large.items(), key=lambda e: str(e[0])):
            trees[g] = Splits(sample.loc[sample["grp"] == g, names].to_numpy(dtype=float).reshape(-1, len(names)), n // block_rows + 1)
            begin[g] = upto
            upto += 2 ** trees[g].depth
    return tasks, trees, begin


def _whole(tasks: int) -> Column:
    return F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("long").alias("task")


def _parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which groups are together, and the ends of the groups."""
    codes, _ = pd.factorize(pdf["grp"])
    order = np.argsort(codes, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(codes[order])) + 1, len(order)) if len(order) else np.zeros(0, dtype=np.int64)


def _answers(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a region's rows ``x`` are to rows ``q`` of other regions: place in ``q``, identifier, distance."""
    _, kept = _places(x, ids, k)
    tree = _Tree(x[kept], ids[kept], max(16, k + 1))
    bound = bound.copy()
    open_ = np.flatnonzero(~np.isfinite(bound))  # too few in their own region: first the k-th of any leaf
    bound[open_] = tree.bounds(q[open_], np.zeros(len(open_), dtype=np.int64), k)
    return tree.search(q, bound, k, digits)


def knn(src: DataFrame, dims: int, k: int, block_rows: int, digits: int) -> DataFrame:
    """``(src, dst, d2, rank)`` of ``(id, v, grp)``, finite vectors of ``dims`` numbers.

    A group of over ``block_rows`` rows is divided into regions of about as many. A row whose neighbours in its region lie beyond the region's border asks the others that its
    ball meets. The driver holds 32 positions a region of such groups.
    """
    names = [f"x{i}" for i in range(dims)]
    rows = cut(src.select("id", "grp", *(F.col("v")[i].alias(c) for i, c in enumerate(names))))
    tasks, trees, begin = _divisions(rows, names, block_rows)
    large = bool(trees)

    def placed(batches):
        for pdf in batches:
            for g in pdf["grp"].unique():
                if g in trees:
                    here = pdf["grp"] == g
                    pdf.loc[here, "task"] = begin[g] + trees[g].leaf(pdf.loc[here, names].to_numpy(dtype=float))
            yield pdf

    cells = rows.select("*", _whole(tasks))
    if large:
        cells = cut(cells.mapInPandas(placed, cells.schema))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        order, ends = _parts(pdf)
        x, ids = pdf[names].to_numpy(dtype=float)[order], pdf["id"].to_numpy(dtype=np.int64)[order]
        out, s = [], 0
        for e in ends:
            out.append(nearest(x[s:e], ids[s:e], k, digits))
            s = e
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("src", "dst", "d2"), zip(*out, strict=True), strict=True)})

    found = cells.groupBy("task").applyInPandas(lambda pdf: inside(pdf), _FOUND)
    if large:
        found = cut(found)
        ball = found.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") == k, F.max("d2")).otherwise(float("inf")).alias("r2"))
        asking = cells.filter(F.col("task") >= tasks).join(ball, "id", "left").fillna(float("inf"), ["r2"])

        def beyond(batches):
            for pdf in batches:
                for g in pdf["grp"].unique():
                    part = pdf[pdf["grp"] == g]
                    row, leaf = trees[g].reach(part[names].to_numpy(dtype=float), part["r2"].to_numpy() * (1 + 1e-12) + 2 * 10.0**-digits)
                    out = part.iloc[row].assign(task=begin[g] + leaf)
                    yield out[out["task"].to_numpy() != part["task"].to_numpy()[row]]

        def outside(asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(has):
                return pd.DataFrame({"src": [], "dst": [], "d2": []}).astype({"src": "int64", "dst": "int64", "d2": float})
            x, ids = has[names].to_numpy(dtype=float), has["id"].to_numpy(dtype=np.int64)
            mine = asks["id"].to_numpy(dtype=np.int64)
            row, dst, d = _answers(asks[names].to_numpy(dtype=float), asks["r2"].to_numpy(), x, ids, k, digits)
            return pd.DataFrame({"src": mine[row], "dst": dst, "d2": d})

        more = asking.mapInPandas(beyond, asking.schema).groupBy("task").cogroup(cells.filter(F.col("task") >= tasks).groupBy("task")).applyInPandas(lambda a, b: outside(a, b), _FOUND)
        found = found.unionByName(more)
    w = Window.partitionBy("src").orderBy("d2", "dst")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row of its component; ``a`` and ``b`` are the ends of links. Each round every component but the first of its neighbours joins one before it."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        open_ = a != b
        a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(root, b, a)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _mutual(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are among each other's neighbours."""
    key, count = np.unique(np.minimum(src, dst) * n + np.maximum(src, dst), return_counts=True)
    return key[count == 2] // max(1, n), key[count == 2] % max(1, n)


def mutual_components(rows: DataFrame, names: list[str], k: int, block_rows: int, digits: int) -> DataFrame:
    """``(id, grp, component)`` of ``(id, grp, *names)``, finite coordinates, each ``id`` once: components of mutual nearest neighbours within groups, named by their smallest ``id``.

    A group that one task holds is done there. In a divided one (as in ``knn``) a region joins its own rows; pairs across borders then join the regions' components.
    """
    kind = rows.schema["grp"].dataType.simpleString()
    tasks, trees, begin = _divisions(rows, names, block_rows)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        order, ends = _parts(pdf)
        x, ids = pdf[names].to_numpy(dtype=float)[order], pdf["id"].to_numpy(dtype=np.int64)[order]
        near, s = [], 0
        for e in ends:
            near.append(nearest(x[s:e], ids[s:e], k, digits)[:2])
            s = e
        src, dst = (np.concatenate(c) for c in zip(*near, strict=True))
        own = np.sort(ids)
        first = joined(len(own), *_mutual(len(own), np.searchsorted(own, src), np.searchsorted(own, dst)))
        return pd.DataFrame({"id": ids, "grp": pdf["grp"].to_numpy()[order], "component": own[first][np.searchsorted(own, ids)]})

    done = f"id long, grp {kind}, component long"
    if not trees:
        return rows.select("*", _whole(tasks)).groupBy("task").applyInPandas(lambda pdf: inside(pdf), done)
    large = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in trees], f"grp {kind}"))
    whole = rows.join(large, "grp", "left_anti").select("id", "grp", *names, _whole(tasks)).groupBy("task").applyInPandas(lambda pdf: inside(pdf), done)
    group = {begin[g] + i: g for g in trees for i in range(2 ** trees[g].depth)}

    def placed(batches):
        for pdf in batches:
            task = np.zeros(len(pdf), dtype=np.int64)
            for g in pdf["grp"].unique():
                here = (pdf["grp"] == g).to_numpy()
                task[here] = begin[g] + trees[g].leaf(pdf.loc[here, names].to_numpy(dtype=float))
            yield pdf.assign(task=task)[["id", *names, "task"]]

    def region(pdf: pd.DataFrame) -> pd.DataFrame:
        """What its rows are to each other, each row to itself as well (``asked`` is -1), and what they ask other regions."""
        task = int(pdf["task"].iloc[0])
        x, ids = pdf[names].to_numpy(dtype=float), pdf["id"].to_numpy(dtype=np.int64)
        order = np.argsort(ids)
        x, ids = x[order], ids[order]
        src, dst, d = nearest(x, ids, k, digits)
        at = np.searchsorted(ids, src)
        most = np.zeros(len(ids))
        np.maximum.at(most, at, d)
        r2 = np.where(np.bincount(at, minlength=len(ids)) == k, most, np.inf)
        g = group[task]
        row, leaf = trees[g].reach(x, r2 * (1 + 1e-12) + 2 * 10.0**-digits)
        row, leaf = row[begin[g] + leaf != task], leaf[begin[g] + leaf != task]
        near = pd.DataFrame({"task": task, "id": np.concatenate([ids, src]), "dst": np.concatenate([ids, dst]), "d2": np.concatenate([np.zeros(len(ids)), d]), "asked": -1, "r2": 0.0, **dict.fromkeys(names, 0.0)})
        asks = pd.DataFrame({"task": task, "id": ids[row], "dst": ids[row], "d2": 0.0, "asked": begin[g] + leaf, "r2": r2[row], **{c: x[row, i] for i, c in enumerate(names)}})
        return pd.concat([near, asks])

    def outside(asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(has):
            return pd.DataFrame({"task": [], "id": [], "dst": [], "d2": []}).astype({"task": "int64", "id": "int64", "dst": "int64", "d2": float})
        mine = asks["id"].to_numpy(dtype=np.int64)
        row, dst, d = _answers(asks[names].to_numpy(dtype=float), asks["r2"].to_numpy(), has[names].to_numpy(dtype=float), has["id"].to_numpy(dtype=np.int64), k, digits)
        return pd.DataFrame({"task": asks["task"].to_numpy()[row], "id": mine[row], "dst": dst, "d2": d})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        """A region's rows with their component in it (``dst`` is the row itself), and their neighbours in other regions."""
        src, dst, d = pdf["id"].to_numpy(dtype=np.int64), pdf["dst"].to_numpy(dtype=np.int64), pdf["d2"].to_numpy(dtype=float)
        own = np.sort(src[src == dst])
        other = src != dst
        at, dst, _ = _first(np.searchsorted(own, src[other]), dst[other], d[other], k)
        to = np.minimum(np.searchsorted(own, dst), len(own) - 1)
        here = own[to] == dst
        component = own[joined(len(own), *_mutual(len(own), at[here], to[here]))]
        at, dst = at[~here], dst[~here]
        rows = np.concatenate([np.arange(len(own)), at])
        return pd.DataFrame({"id": own[rows], "grp": group[int(pdf["task"].iloc[0])], "component": component[rows], "dst": np.concatenate([own, dst])})

    coordinates = ", ".join(f"{c} double" for c in names)
    cells = cut(rows.join(large, "grp", "left_semi").select("id", "grp", *names).mapInPandas(placed, f"id long, {coordinates}, task long"))
    near = cut(cells.groupBy("task").applyInPandas(lambda pdf: region(pdf), f"task long, id long, dst long, d2 double, asked long, r2 double, {coordinates}"))
    asks = near.filter("asked >= 0").select("task", "id", "asked", "r2", *names)
    more = asks.groupBy("asked").cogroup(cells.groupBy("task")).applyInPandas(lambda a, b: outside(a, b), "task long, id long, dst long, d2 double")
    found = near.filter("asked < 0").select("task", "id", "dst", "d2").unionByName(more)
    found = cut(found.groupBy("task").applyInPandas(lambda pdf: merged(pdf), f"id long, grp {kind}, component long, dst long"))
    across = found.filter("dst <> id").groupBy(F.least("id", "dst"), F.greatest("id", "dst")).agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b"))
    over = connected_components(across.filter("n = 2").select("a", "b").distinct(), "a", "b").select(F.col("id").alias("component"), F.col("component").alias("first"))
    divided = found.filter("dst = id").join(over, "component", "left").select("id", "grp", F.coalesce("first", "component").alias("component"))
    return whole.unionByName(divided)
