"""Layouts of linked nodes, their alignment with positions, displacement and blending."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.dimred import embed_neighbours, fuzzy_weights
from papyrine.operators.graph import connected_components
from papyrine.operators.steps import linked_weights, near_by_hops
from papyrine.session import cut

_XYZ = "node_id long, x double, y double, z double"


def rotations(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of many matrices Σ a bᵀ the proper rotation that turns a onto b best, and the trace it reaches."""
    if not len(cross):
        return np.zeros((0, 3, 3)), np.zeros(0)
    u, s, vt = np.linalg.svd(cross)
    v = np.swapaxes(vt, 1, 2)
    flip = np.where(np.linalg.det(v @ np.swapaxes(u, 1, 2)) < 0, -1.0, 1.0)
    v = v * np.stack([np.ones_like(flip), np.ones_like(flip), flip], axis=1)[:, None, :]
    return v @ np.swapaxes(u, 1, 2), s[:, 0] + s[:, 1] + flip * s[:, 2]


def align(target: DataFrame, source: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The source turned, scaled and shifted onto the target, group by group: ``(node_id, x, y, z)``, and ``(correlation)``.

    Sums of every group are added up in the cluster; only ten numbers a group go through numpy. A group of one takes the target's place.
    """
    j = _beside(target, source, groups, [])
    turned = cut(_turned(j, []))
    k = j.join(turned, "component")
    d = [F.col(f"a{c}") - F.col(f"ma{c}") for c in "xyz"]
    moved = [F.when(F.col("n") == 1, F.col(f"b{c}")).otherwise(F.col("scale") * (F.col(f"r{i}0") * d[0] + F.col(f"r{i}1") * d[1] + F.col(f"r{i}2") * d[2]) + F.col(f"mb{c}")).alias(c) for i, c in enumerate("xyz")]
    return k.select("node_id", *moved), _correlation(turned, [])


def _beside(target: DataFrame, source: DataFrame, groups: DataFrame | None, by: list[str]) -> DataFrame:
    t = target.select("node_id", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    j = source.select(*by, "node_id", *(F.col(c).alias(f"a{c}") for c in "xyz")).join(t, "node_id")
    return j.join(groups.select("node_id", "component"), "node_id") if groups is not None else j.withColumn("component", F.lit(0).cast("long"))


def _turned(j: DataFrame, by: list[str]) -> DataFrame:
    """For each of ``by`` and component the means, spreads, rotation, scale and trace."""
    means = [F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "ab" for c in "xyz"]
    cross = [F.covar_pop(f"a{p}", f"b{q}").alias(f"s{p}{q}") for p in "xyz" for q in "xyz"]
    spread = [(sum(F.var_pop(f"{s}{c}") for c in "xyz")).alias(f"v{s}") for s in "ab"]
    sums = j.groupBy(*by, "component").agg(F.count("*").alias("n"), *means, *cross, *spread)
    names = [f"r{i}{k}" for i in range(3) for k in range(3)]

    def solve(batches):
        for pdf in batches:
            out = pdf[[*by, "component", "n", "max", "may", "maz", "mbx", "mby", "mbz", "va", "vb"]].copy()
            n, va, vb = (pdf[c].to_numpy(dtype=float) for c in ("n", "va", "vb"))
            rot, trace = rotations(pdf[[f"s{p}{q}" for p in "xyz" for q in "xyz"]].to_numpy(dtype=float).reshape(-1, 3, 3) * n[:, None, None])
            alone = n <= 1
            out[names] = np.where(alone[:, None], np.eye(3).ravel(), rot.reshape(-1, 9))
            scale = np.sqrt(np.divide(vb, va, out=np.ones_like(va), where=va * n > 1e-9))
            out["trace"], out["scale"] = np.where(alone, 0.0, trace), np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)
            yield out

    cols = [*(f"{c} int" for c in by), "component long", "n long", *(f"m{s}{c} double" for s in "ab" for c in "xyz"), "va double", "vb double", *(f"{x} double" for x in names), "trace double", "scale double"]
    return sums.mapInPandas(solve, ", ".join(cols))


def _correlation(turned: DataFrame, by: list[str]) -> DataFrame:
    weight = F.sqrt(F.col("va") * F.col("vb")) * F.col("n")
    return turned.filter("n > 1 and va > 0 and vb > 0").groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("trace") / F.sum(weight))).alias("correlation"))


def correlations(target: DataFrame, source: DataFrame, groups: DataFrame) -> DataFrame:
    """``(job, correlation)`` of several layouts (job, node_id, x, y, z), each aligned with the target group by group; none for a layout without groups that vary."""
    return _correlation(_turned(_beside(target, source, groups, ["job"]), ["job"]), ["job"])


def align_by_component(base: DataFrame, layout: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = base.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    comp = connected_components(edges.select("src", "dst").unionByName(own)).select(F.col("id").alias("node_id"), "component")
    return align(base, layout, comp)


def displacement(pre: DataFrame, post: DataFrame) -> DataFrame:
    """``(node_id, moved)``: distance between a node's places after aligning one layout with the other as a whole."""
    turned, _ = align(pre, post)
    a, b = (d.select("node_id", *(F.col(c).alias(c + s) for c in "xyz")) for d, s in ((pre, "0"), (turned, "1")))
    return a.join(b, "node_id").select("node_id", F.sqrt(sum((F.col(c + "0") - F.col(c + "1")) ** 2 for c in "xyz")).alias("moved"))


def blend(pre: DataFrame | None, post: DataFrame, cited: DataFrame | None, fusion: float = 1.0, citation: float = 0.0) -> DataFrame:
    """``(node_id, x, y, z)`` = (1 - citation) · ((1 - fusion) pre + fusion post) + citation · cited, the shares clamped to [0, 1]; without a layout its share is 0."""
    f, a = min(max(fusion, 0.0), 1.0), min(max(citation, 0.0), 1.0)
    j = post.select("node_id", *(F.col(c).alias(c + "2") for c in "xyz"))
    mid: dict[str, Column] = {c: F.col(c + "2") for c in "xyz"}
    if pre is not None and f < 0.999:
        j = j.join(pre.select("node_id", *(F.col(c).alias(c + "1") for c in "xyz")), "node_id")
        mid = {c: (1 - f) * F.col(c + "1") + f * F.col(c + "2") for c in "xyz"}
    if cited is not None:
        j = j.join(cited.select("node_id", *(F.col(c).alias(c + "3") for c in "xyz")), "node_id")
        mid = {c: (1 - a) * mid[c] + a * F.col(c + "3") for c in "xyz"}
    return j.select("node_id", *(v.alias(c) for c, v in mid.items()))


def _rows(n: int, cells: int = 1 << 16) -> int:
    """As many rows of n columns as the processor's cache holds."""
    return max(1, cells // max(1, n))


def _apart(rows: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Differences between some rows and all, axis by axis, and their squared lengths."""
    d = [rows[:, c, None] - y[None, :, c] for c in range(y.shape[1])]
    return d, sum(v * v for v in d)


def _smacof(d: np.ndarray, seed: int, rounds: int = 60) -> np.ndarray:
    n, block = len(d), _rows(len(d))
    y = np.random.default_rng(seed).normal(size=(n, 3)) * max(1.0, d.max())
    for _ in range(rounds):
        new = np.empty_like(y)
        for i in range(0, n, block):
            z = y[i : i + block]
            own = np.sqrt(_apart(z, y)[1])
            ratio = np.divide(d[i : i + block], own, out=np.zeros_like(own), where=own > 1e-12)
            new[i : i + block] = (ratio.sum(1)[:, None] * z - ratio @ y) / n
        y = new
    return y


def _adjacent(n: int, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's neighbours begin, and all neighbours in ascending order, of links that are there once."""
    both = np.concatenate([e[:, 0].astype(np.int64) * n + e[:, 1], e[:, 1].astype(np.int64) * n + e[:, 0]])
    both.sort()
    first = np.searchsorted(both, np.arange(n + 1, dtype=np.int64) * n)
    both %= n
    return first, both.astype(np.int32)


def _hops_from(n: int, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of steps from every node (rows) of one component to each of ``starts``, a multiple of 64 of them; all starts go forward together, as bits."""
    return _hops(*_adjacent(n, e), starts)


def _hops(first: np.ndarray, b: np.ndarray, starts: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """``_hops_from`` over ``_adjacent``; a byte each, two where there are more steps."""
    n = len(first) - 1
    front = np.zeros((n, len(starts) // 64), dtype=np.uint64)
    column = np.arange(len(starts))
    np.bitwise_or.at(front.view(np.uint8), (starts, column // 8), (128 >> column % 8).astype(np.uint8))
    seen, d, k = front.copy(), np.zeros((n, len(starts)), dtype=np.uint8), 0
    while front.any():
        k += 1
        front = np.bitwise_or.reduceat(front[b], first[:-1], axis=0) & ~seen  # every node of a component has a link
        seen |= front
        if k == 256:
            d = d.astype(np.uint16)
        for i in range(0, n, block):
            part = front[i : i + block]
            if part.any():
                d[i : i + block][np.unpackbits(part.view(np.uint8), axis=1).view(bool)] = k
    return d


def _pivots(n: int, e: np.ndarray, seed: int, pivots: int = 256, rounds: int = 60, block: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_around`` needs for ``_smacof`` of a large component, each node's mean over all others taken over ``pivots`` random ones, which are laid out first.

    Blocks of nodes come several times, with their steps to 64 of the pivots: (first node, number of the 64, steps, places to begin at, pivots' nodes, pivots' places).
    Nothing is as wide as all pivots for all nodes; steps are found once more instead.
    """
    starts = np.sort(np.random.default_rng(seed).choice(n, pivots, replace=False))
    first, b = _adjacent(n, e)
    among, most = [], 0
    for i in range(0, pivots, 64):
        d = _hops(first, b, starts[i : i + 64])
        among.append(d[starts].astype(float))
        most = max(most, int(d.max()))
        del d
    at = _smacof(np.concatenate(among, axis=1), seed, rounds)
    for i in range(0, pivots, 64):
        d = _hops(first, b, starts[i : i + 64])
        rng = np.random.default_rng(seed + 1)
        for k in range(0, n, block):
            y = rng.normal(size=(min(block, n - k), 3)) * max(1.0, float(most))
            own = (starts >= k) & (starts < k + block)
            y[starts[own] - k] = at[own]
            yield k, i // 64, d[k : k + block], y, starts, at
        del d


def _around(steps: np.ndarray, y: np.ndarray, at: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Nodes' places after ``rounds`` means over pivots that stay where they are."""
    square, mean, want, z = (at**2).sum(1), at.mean(0), steps.astype(float), y
    for _ in range(rounds):
        own = np.sqrt(np.maximum((z**2).sum(1)[:, None] + square - 2 * z @ at.T, 0))
        ratio = np.divide(want, own, out=np.zeros_like(own), where=own > 1e-6)
        z = mean + (ratio.sum(1)[:, None] * z - ratio @ at) / len(at)
    return z


def _repulsion(y: np.ndarray) -> np.ndarray:
    """Sums of (a - b) / |a - b|² over all pairs, in blocks of rows."""
    out, block = np.empty_like(y), _rows(len(y))
    for i in range(0, len(y), block):
        delta, square = _apart(y[i : i + block], y)
        share = 1 / (np.sqrt(square) + 1e-6) ** 2
        for c, v in enumerate(delta):
            out[i : i + block, c] = np.einsum("ij,ij->i", v, share)
    return out


class _Mesh:
    """The same sums for many nodes in a ball: those of (a - b) / (|a - b|² + h²) over a mesh of spacing h, by Fourier transforms; the rest, which falls with
    the third power of the distance, over the cells around a node, by one random node of each of 27 cells, counted as often as the cell has nodes."""

    def __init__(self, half: float, cells: int, seed: int):
        self.m, self.low, self.h = cells, -half, 2 * half / (cells - 1)
        x = np.concatenate([np.arange(cells), np.arange(-cells, 0)]) * self.h
        p, q, r = np.meshgrid(x, x, x, indexing="ij", sparse=True)
        soft = p**2 + q**2 + r**2 + self.h**2
        self.kernels = [np.fft.rfftn((c / soft).astype(np.float32)) for c in (p, q, r)]
        self.rng = np.random.default_rng(seed)

    def __call__(self, y: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        m, n = self.m, len(y)
        parts = [slice(i, i + block) for i in range(0, n, block)]
        wide = m + 2  # a margin of empty cells

        def spots(part: slice) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
            u = np.clip((y[part] - self.low) / self.h, 0, m - 1.001)
            base = u.astype(int)
            f = u - base
            cell = (base[:, 0] * m + base[:, 1]) * m + base[:, 2]
            x, y_, z = (np.stack([1 - f[:, c], f[:, c]]) for c in range(3))
            return ((base[:, 0] + 1) * wide + base[:, 1] + 1) * wide + base[:, 2] + 1, [(cell + (a * m + b) * m + c, x[a] * y_[b] * z[c]) for a, b, c in np.ndindex(2, 2, 2)]

        mass, cell = np.zeros(m**3), np.empty(n, dtype=np.int32)
        for part in parts:
            cell[part], near = spots(part)
            for at, w in near:
                mass += np.bincount(at, w, m**3)
        spread = np.fft.rfftn(mass.reshape(m, m, m).astype(np.float32), (2 * m,) * 3, (0, 1, 2))
        fields = [np.fft.irfftn(spread * kernel, (2 * m,) * 3, (0, 1, 2))[:m, :m, :m].ravel() for kernel in self.kernels]
        out = np.empty((n, 3))
        for part in parts:
            _, near = spots(part)
            for c, field in enumerate(fields):
                out[part, c] = sum(w * field[at] for at, w in near)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        count = np.bincount(cell, minlength=wide**3)
        first = np.cumsum(count) - count
        axes, more = [y[order, c] for c in range(3)], np.zeros((3, n))
        parts = [slice(i, i + (1 << 14)) for i in range(0, n, 1 << 14)]  # as the processor's cache holds
        for a, b, c in np.ndindex(3, 3, 3):
            for part in parts:
                near = cell[part] + (((a - 1) * wide + b - 1) * wide + c - 1)
                k = count[near]
                j = np.minimum(first[near] + (self.rng.random(len(near)) * k).astype(int), n - 1)  # a node picked itself adds nothing, nor does an empty cell
                delta = [v[part] - v[j] for v in axes]
                d2 = sum(v * v for v in delta)
                share = k * self.h**2 / ((d2 + 1e-6) * (d2 + self.h**2))
                for to, v in zip(more, delta, strict=True):
                    to[part] += v * share
        for c in range(3):
            out[order, c] += more[c]
        return out


def _forces(n: int, e: np.ndarray, t: np.ndarray, seed: int, rounds: int = 200, radius: float = 90.0, exact: int = 3000) -> np.ndarray:
    """Beyond ``exact`` nodes the repulsion is that of ``_Mesh``."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 3)) * radius / 3
    k = radius * (4 / max(n, 1)) ** (1 / 3)
    repulsion = _repulsion if n <= exact else _Mesh(1.5 * radius, 64, seed)
    ends = [np.ascontiguousarray(e[:, c]) for c in (0, 1)]
    block, row = max(1 << 18, n // 2), 1 << 17
    for r in range(rounds):
        push = repulsion(y)
        push *= k * k
        for i in range(0, len(e), block):
            a, b = (x[i : i + block] for x in ends)
            d = y[a] - y[b]
            d *= (np.sqrt((d**2).sum(1)) / k)[:, None]
            for c in range(3):
                push[:, c] += np.bincount(b, d[:, c], n) - np.bincount(a, d[:, c], n)
        for i in range(0, n, row):
            z, g = y[i : i + row], push[i : i + row]
            out = np.sqrt((z**2).sum(1)) + 1e-6
            g -= z / out[:, None] * ((out - (0.2 + 0.8 * (1 - t[i : i + row])) * radius) * 0.5)[:, None]  # older nodes further out
            size = np.sqrt((g**2).sum(1)) + 1e-9
            z += g / size[:, None] * np.minimum(size, radius * 0.1 * (1 - r / rounds))[:, None]
            far = np.sqrt((z**2).sum(1))
            z[:] = np.where((far > 1.5 * radius)[:, None], z / far[:, None] * 1.5 * radius, z)
    return y


#: Methods with their parameters: kind, range, the values a sweep tries.
LAYOUTS = {
    "forces": {"label": "Forces", "parameters": {"iterations": {"kind": "int", "min": 50, "max": 600, "default": 200, "sweep": [100, 200, 400]}}},
    "mds": {"label": "Distances in steps", "parameters": {"iterations": {"kind": "int", "min": 50, "max": 600, "default": 60, "sweep": [60, 100, 200]}, "scale": {"kind": "float", "min": 1, "max": 30, "default": 1.0, "sweep": [6, 12, 18, 24]}}},
    "umap-graph": {"label": "Neighbour embedding of the links", "parameters": {"neighbours": {"kind": "int", "min": 4, "max": 50, "default": 15, "sweep": [10, 15, 25, 40]}, "iterations": {"kind": "int", "min": 50, "max": 2000, "default": 200, "sweep": [200, 500, 1000]}}},
}


def parameters(method: str, **given) -> dict:
    """The parameters of a method, defaults where none are given; unknown methods, names and values out of range raise."""
    if method not in LAYOUTS:
        raise KeyError(f"no layout {method!r}; there are {', '.join(LAYOUTS)}")
    schema = LAYOUTS[method]["parameters"]
    for name, v in given.items():
        if name not in schema:
            raise TypeError(f"{method} has no parameter {name}")
        if not schema[name]["min"] <= v <= schema[name]["max"]:
            raise ValueError(f"{name} = {v} is out of range")
    return {n: given.get(n, f["default"]) for n, f in schema.items()}


def layout(method: str, nodes: DataFrame, edges: DataFrame, seed: int = 1, most_in_task: int = 3000, **given) -> DataFrame:
    """``(node_id, x, y, z)``: every component laid out in a task of its own; components are set apart by a seeded place.

    "umap-graph" embeds, for each node, as many neighbours by steps along the links as ``neighbours`` says, itself among them, weighted like distances.

    In components beyond ``most_in_task`` nodes all pairs are approximated: the repulsion of "forces" on a mesh, the stress of "mds" by random pivots. All
    methods hold a component's links in one task.
    """
    parameters(method, **given)
    return layouts([(method, seed, given)], nodes, edges, components(nodes, edges), most_in_task).select("node_id", "x", "y", "z")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, component)`` of all nodes."""
    own = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return cut(connected_components(edges.select("src", "dst").unionByName(own)).select(F.col("id").alias("node_id"), "component"))


def _linked(src: np.ndarray, t: np.ndarray, count: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A component's nodes in ascending order, their times, and its links, once each, as pairs of places in that order; from each node's number of links and all other ends."""
    ids, at = np.unique(src, return_index=True)
    n = len(ids)
    a, b = np.repeat(np.searchsorted(ids, src), count), np.minimum(np.searchsorted(ids, dst), n - 1)
    known = (ids[b] == dst) & (a != b)
    a, b = a[known], b[known]
    key = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    return ids, t[at], np.stack([key // n, key % n], 1).astype(np.int32)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``_linked`` of each slot (slot, src, t, dst) in a partition; batches aren't kept."""
    parts: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        slots = batch.column("slot").to_numpy()
        for slot in np.unique(slots):
            own = batch.filter(pa.array(slots == slot))
            ends = own.column("dst")
            count = pc.fill_null(pc.list_value_length(ends), 0).to_numpy(zero_copy_only=False)
            new = [*(own.column(c).to_numpy(zero_copy_only=False) for c in ("src", "t")), count, ends.flatten().to_numpy(zero_copy_only=False)]
            for kept, x in zip(parts.setdefault(int(slot), [[], [], [], []]), new, strict=True):
                kept.append(x.copy())
    while parts:
        slot, columns = parts.popitem()
        yield slot, *_linked(*(np.concatenate(columns.pop(0)) for _ in range(4)))


def layouts(jobs: list[tuple[str, int, dict]], nodes: DataFrame, edges: DataFrame, comp: DataFrame, most_in_task: int = 3000) -> DataFrame:
    """``(job, node_id, x, y, z)`` of several layouts (method, seed, parameters), numbered from 0, side by side: a task holds a component of one of them.

    Tasks of components beyond ``most_in_task`` nodes keep numbers of four bytes for nodes, read rows in batches and work through nodes and links in blocks; under "mds" they only
    find steps to pivots, and blocks of nodes are placed in tasks of their own.
    """
    settings = [(m, s, parameters(m, **given)) for m, s, given in jobs]
    out = edges.select("src", "dst").filter("src is not null and dst is not null").groupBy("src").agg(F.collect_list("dst").alias("dst"))
    rows = nodes.select(F.col("node_id").alias("src"), F.coalesce("t", F.lit(0.0)).alias("t")).join(out, "src", "left")
    rows = cut(rows.join(comp.select(F.col("node_id").alias("src"), "component"), "src"))
    sizes = cut(comp.groupBy("component").agg(F.count("*").alias("size")))
    large = [r["component"] for r in sizes.filter(F.col("size") > most_in_task).orderBy(F.desc("size"), "component").select("component").collect()]  # few: at most one in most_in_task nodes
    chance = lambda job, component: (settings[job][1] * 1_000_003 + component) % 2**32
    of = lambda numbers: F.explode(F.array(*(F.lit(i) for i in numbers)))

    # Small components share tasks, so that there aren't as many tasks' worth of rows as components.
    small = rows.join(sizes.filter(F.col("size") <= most_in_task), "component").withColumn("job", of(range(len(jobs))))
    small = small.withColumn("bin", F.when(F.col("size") > 256, F.col("component")).otherwise(-1 - F.pmod("component", F.lit(64))))

    def one(job: int, component: int, pdf: pd.DataFrame) -> pd.DataFrame:
        method, _, p = settings[job]
        lists = [x if x is not None else () for x in pdf["dst"]]
        ids, t, pairs = _linked(pdf["src"].to_numpy(), pdf["t"].to_numpy(), np.array([len(x) for x in lists]), np.array([v for x in lists for v in x], dtype=np.int64))
        n, s = len(ids), chance(job, component)
        if method == "mds":
            steps = _hops_from(n, pairs, np.resize(np.arange(n), -(-n // 64) * 64))[:, :n]
            y = _smacof(steps.astype(float), s, p["iterations"]) * p["scale"]
        elif method == "forces":
            y = _forces(n, pairs, t, s, p["iterations"], exact=most_in_task)
        else:
            near, hops = near_by_hops(*_adjacent(n, pairs), ids, p["neighbours"] - 1, settings[job][1])
            src, k = np.nonzero(near >= 0)
            a, b, w = fuzzy_weights(n, src, near[src, k].astype(int), hops[src, k].astype(float), p["neighbours"])
            y = embed_neighbours(n, a, b, w, 3, p["iterations"], s)
        y = y + np.random.default_rng(s).normal(size=3) * 30 * (1 if n < 10 else 0)
        return pd.DataFrame({"job": job, "node_id": ids, "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        job = int(key[0])
        alone = pdf[pdf["size"] == 1].drop_duplicates("src")
        out = [one(job, int(c), part) for c, part in pdf[pdf["size"] > 1].groupby("component")]
        if len(alone):
            at = np.array([np.random.default_rng(chance(job, int(c))).normal(size=3) * 30 for c in alone["component"]])
            out.append(pd.DataFrame({"job": job, "node_id": alone["src"].to_numpy(), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
        return pd.concat(out)

    # As many partitions as said, which aren't put together however few rows they have: a row costs far more than it takes up.
    schema = f"job int, {_XYZ}"
    placed = small.repartition(16 * len(jobs), "job", "bin").groupBy("job", "bin").applyInPandas(place, schema)
    if not large:
        return placed

    of_slot = lambda slot: (slot % len(jobs), large[slot // len(jobs)])
    ranks = nodes.sparkSession.createDataFrame(list(enumerate(large)), "rank int, component long")
    wide = rows.join(F.broadcast(ranks), "component")

    def slots(numbers: list[int]) -> DataFrame:
        """Rows of each large component and layout, in a partition of their own."""
        each = wide.withColumn("job", of(numbers)).select((F.col("rank") * len(jobs) + F.col("job")).alias("slot"), "src", "t", "dst")
        at = {j: i for i, j in enumerate(numbers)}
        n = len(large) * len(numbers)
        own = F.create_map(*(F.lit(x) for kv in at.items() for x in kv))[F.col("slot") % len(jobs)]
        return each.repartitionById(min(n, 10_000), (F.floor(F.col("slot") / len(jobs)).cast("int") * len(numbers) + own) % min(n, 10_000))

    def batches(job: int, ids: np.ndarray, y: np.ndarray, block: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), block):
            z = y[i : i + block]
            yield pa.record_batch([pa.array(np.full(len(z), job, dtype=np.int32)), pa.array(ids[i : i + block]), *(pa.array(np.ascontiguousarray(z[:, c])) for c in range(3))], names=["job", "node_id", *"xyz"])

    def whole(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, ids, t, pairs in _collected(rows_):
            job, component = of_slot(slot)
            method, seed, p = settings[job]
            s, n = chance(job, component), len(ids)
            if method == "forces":
                y = _forces(n, pairs, t, s, p["iterations"], exact=most_in_task)
            else:
                near, weight = linked_weights(*_adjacent(n, pairs), ids, p["neighbours"], seed)
                del pairs
                y = embed_neighbours(n, near.shape[1], near.ravel(), weight.ravel(), 3, p["iterations"], s)
            yield from batches(job, ids, y)

    def steps(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, ids, _, pairs in _collected(rows_):
            for first, part, d, y, starts, at in _pivots(len(ids), pairs, chance(slot % len(jobs), of_slot(slot)[1]), rounds=settings[slot % len(jobs)][2]["iterations"]):
                own = [x.tobytes() if not part else b"" for x in (ids[first : first + len(y)], y, ids[starts], at)]
                yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([first], pa.int64()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (d.astype(np.uint16).tobytes() if d.itemsize > 1 else d.tobytes(), *own))], names=["slot", "first", "part", "steps", "ids", "y", "starts", "at"])

    def round_pivots(key, pdf: pd.DataFrame) -> pd.DataFrame:
        job = int(key[0]) % len(jobs)
        pdf = pdf.sort_values("part")
        ids, starts = (np.frombuffer(pdf[c].iloc[0], dtype=np.int64) for c in ("ids", "starts"))
        y, at = (np.frombuffer(pdf[c].iloc[0]).reshape(-1, 3) for c in ("y", "at"))
        d = np.concatenate([np.frombuffer(x, dtype=np.uint8 if len(x) == 64 * len(ids) else np.uint16).reshape(len(ids), 64) for x in pdf["steps"]], axis=1)
        fixed = np.minimum(np.searchsorted(starts, ids), len(starts) - 1)
        y = np.where((starts[fixed] == ids)[:, None], at[fixed], _around(d, y, at, settings[job][2]["iterations"])) * settings[job][2]["scale"]
        return pd.DataFrame({"job": job, "node_id": ids, "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

    by_steps = [i for i, (m, _, _) in enumerate(settings) if m == "mds"]
    others = [i for i in range(len(jobs)) if i not in by_steps]
    parts = [slots(others).mapInArrow(whole, schema)] if others else []  # the longest tasks come first
    if by_steps:
        d = slots(by_steps).mapInArrow(steps, "slot int, first long, part int, steps binary, ids binary, y binary, starts binary, at binary")
        parts.append(d.repartition(16 * len(jobs), "slot", "first").groupBy("slot", "first").applyInPandas(round_pivots, schema))
    return reduce(DataFrame.unionByName, [*parts, placed])
