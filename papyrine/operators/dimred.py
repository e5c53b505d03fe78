"""Reducing and smoothing vectors: registry, identity, principal components, graph diffusion, layout scale, neighbour embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.skew import join_hot
from papyrine.operators.vectors import pca
from papyrine.session import cut

#: Slots of a reduction and the methods that fit.
SLOTS = {"noise": ["identity", "pca", "umap"], "fusion": ["identity", "diffusion"], "compression": ["identity", "pca", "umap"], "viz": ["identity", "pca", "umap"], "viz2d": ["pca", "umap"]}
DEFAULTS = {"identity": {}, "pca": {"components": 50}, "umap": {"components": 3, "neighbours": 15, "epochs": 200}, "diffusion": {"alpha": 0.5, "iterations": 4}}


def list_methods(slot: str) -> list[str]:
    return SLOTS[slot]


def defaults(slot: str, method: str) -> dict:
    if method not in SLOTS[slot]:
        raise KeyError(f"{method!r} doesn't fit the slot {slot!r}")
    fixed = {"viz": {"components": 3}, "viz2d": {"components": 2}}.get(slot, {}) if method in ("pca", "umap") else {}
    return DEFAULTS[method] | fixed


def diffuse(vectors: DataFrame, edges: DataFrame, alpha: float = 0.5, iterations: int = 4, ghosts: DataFrame | None = None, ghost_degree: bool = True, cut_every: int = 4) -> DataFrame:
    """``(node_id, vec)`` after ``iterations`` steps of X' = (1 - alpha) X0 + alpha D⁻¹ A X.

    ``vectors``: (node_id, vec), all of one length; ``edges``: (src, dst), taken in both directions, once each. Ghosts have no X0: they begin at the mean of their
    other neighbours (or 0) and go to the mean of all. ``ghost_degree=False`` drops the edges at ghosts. A node without edges keeps (1 - alpha) of its vector; without
    any edges vectors stay as they are. A step shuffles a vector once for each link's other end, sums by position before the shuffle; hubs' links stay where they are.
    """
    alpha, iterations = min(max(alpha, 0.0), 0.999), int(min(max(round(iterations), 0), 50))
    vectors = vectors.select("node_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    real = vectors.select("node_id").distinct()
    members = real if ghosts is None else real.unionByName(ghosts.select("node_id"))
    both = both.join(members.withColumnRenamed("node_id", "a"), "a", "left_semi").join(members.withColumnRenamed("node_id", "b"), "b", "left_semi")
    if ghosts is not None and not ghost_degree:
        both = both.join(real.withColumnRenamed("node_id", "a"), "a", "left_semi").join(real.withColumnRenamed("node_id", "b"), "b", "left_semi")
    both = cut(both)
    if both.isEmpty() or not iterations:
        return vectors
    dims = vectors.agg(F.max(F.size("vec"))).first()[0]
    counts = cut(both.groupBy("b").agg(F.count("*").alias("n")))  # links of each end; both directions are there, so also its degree
    anchor = vectors.select(F.col("node_id").alias("a"), F.col("vec").alias("x0"))
    total = F.array(*(F.sum(F.col("vec")[i]) for i in range(dims)))
    over = lambda v, k: F.transform(v, lambda x: x / k)

    def spread(now: DataFrame, links: DataFrame, n: DataFrame) -> DataFrame:
        return join_hot(links, now.withColumnRenamed("node_id", "b"), "b", n).groupBy("a").agg(total.alias("s"), F.count("*").alias("seen"))

    now = vectors
    if ghosts is not None:
        own = both.join(ghosts.withColumnRenamed("node_id", "a"), "a", "left_semi").join(real.withColumnRenamed("node_id", "b"), "b", "left_semi")
        start = spread(vectors, own, own.groupBy("b").agg(F.count("*").alias("n"))).select(F.col("a").alias("node_id"), over("s", F.col("seen")).alias("vec"))
        now = cut(now.unionByName(start))
    degree = counts.select(F.col("b").alias("a"), F.col("n").alias("k"))
    for step in range(1, iterations + 1):
        mean = spread(now, both, counts).join(degree, "a").select("a", over("s", F.col("k")).alias("m"))
        kept = F.transform("x0", lambda x: (1 - alpha) * x)
        mixed = F.zip_with("x0", "m", lambda x, m: (1 - alpha) * x + alpha * m)
        now = mean.join(anchor, "a", "full").select(F.col("a").alias("node_id"), F.when(F.col("x0").isNull(), F.col("m")).when(F.col("m").isNull(), kept).otherwise(mixed).alias("vec"))
        if step % cut_every == 0:
            now = cut(now)
    return now


def viewer_scale(pos: DataFrame, target: float = 90.0) -> DataFrame:
    """``(node_id, x, y, z)`` centred, with root mean square radius ``target``."""
    mean = pos.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rms"))  # one row
    k = F.when(F.col("rms") > 0, F.lit(target) / F.col("rms")).otherwise(1.0)
    return pos.crossJoin(F.broadcast(mean)).select("node_id", *(((F.col(c) - F.col(f"m{c}")) * k).alias(c) for c in "xyz"))


def embed_neighbours(n: int, rows: np.ndarray | int, cols: np.ndarray, weight: np.ndarray, dims: int, epochs: int, seed: int, start: np.ndarray | None = None, block: int = 1 << 18) -> np.ndarray:
    """Places n points so that linked ones lie near: attraction along weighted links, repulsion from random others, steps that shrink.

    ``rows`` is a number where each point in turn has as many links; those of weight 0 are none. Links are gone through in blocks, places move once all of them are.
    """
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, dims)) * 10 if start is None else start * (10 / max(1e-9, np.abs(start).max())) + rng.normal(size=(n, dims)) * 1e-3
    if not len(cols):
        return y
    a, b = 1.577, 0.895  # curve of the low-dimensional similarity for a minimum distance of 0.1
    p = weight / weight.max()
    axes = [np.ascontiguousarray(c) for c in y.T]
    moves = np.zeros((dims, n))
    block = max(block, n // 2)

    def gaps(i: np.ndarray, j: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        d = [c[i] - c[j] for c in axes]
        d2 = sum(v * v for v in d)
        return d, d2, np.maximum(d2, 1e-9)

    def moved(rate: float) -> None:
        for c, m in zip(axes, moves, strict=True):
            c += m * rate
        moves[:] = 0

    for epoch in range(epochs):
        rate = 1.0 * (1 - epoch / epochs)
        drawn = []
        for k in range(0, len(p), block):
            on = np.flatnonzero(rng.random(min(block, len(p) - k)) < p[k : k + block])
            i, j = (k + on) // rows if isinstance(rows, int) else rows[k + on], cols[k + on]
            if not len(i):
                continue
            drawn.append((i.astype(np.int32), int(i.min())))
            d, _, safe = gaps(i, j)
            power = safe**b
            pull = -2 * a * b * power / (safe * (1 + a * power))
            for m, v in zip(moves, d, strict=True):
                g = np.clip(pull * v, -4, 4)
                _add(m, i, g, drawn[-1][1])
                m -= np.bincount(j, g, n)
        moved(rate)
        for _ in range(5):
            for i, least in drawn:
                d, d2, safe = gaps(i, rng.integers(0, n, len(i)))  # a point drawn itself isn't pushed: its gaps are 0
                push = 2 * b / ((0.001 + d2) * (1 + a * safe**b))
                for m, v in zip(moves, d, strict=True):
                    _add(m, i, np.clip(push * v, -4, 4), least)
            moved(rate)
    return np.stack(axes, axis=1)


def _add(total: np.ndarray, at: np.ndarray, values: np.ndarray, least: int) -> None:
    """Adds values to the places they belong to; of these the first is known, they often lie close together."""
    sums = np.bincount(at - least, values)
    total[least : least + len(sums)] += sums


def fuzzy_weights(n: int, src: np.ndarray, dst: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symmetric membership weights of a neighbour graph: each point's distances less its nearest, scaled so that weights add up to log2 k."""
    order = np.lexsort((dist, src))
    src, dst = src[order], dst[order]
    w = memberships(n, src, dist[order], k)
    pair = pd.DataFrame({"a": np.minimum(src, dst), "b": np.maximum(src, dst), "w": w}).groupby(["a", "b"])["w"].agg(["sum", "prod", "size"]).reset_index()
    both = np.where(pair["size"] > 1, pair["sum"] - pair["prod"], pair["sum"])
    return pair["a"].to_numpy(), pair["b"].to_numpy(), both


def memberships(n: int, src: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Weights of ``fuzzy_weights`` before the two directions are put together, of rows in the order of src and distance."""
    first = np.searchsorted(src, np.arange(n))
    rho = np.full(n, 0.0)
    has = np.bincount(src, minlength=n) > 0
    rho[has] = dist[first[has]]
    lo, hi, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    target = np.log2(max(k, 2))
    for _ in range(40):
        w = np.exp(-np.maximum(dist - rho[src], 0) / sigma[src])
        total = np.bincount(src, w, n)
        big = total > target
        hi = np.where(big, sigma, hi)
        lo = np.where(big, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + np.where(np.isinf(hi), lo, hi)) / 2)
        sigma = np.clip(sigma, 1e-6, 1e6)
    return np.exp(-np.maximum(dist - rho[src], 0) / sigma[src])


def umap_links(df: DataFrame, ident: str, vector: str, neighbours: int = 15) -> DataFrame:
    """``(src, dst, d)``: the neighbour links that a placement starts from, and a row without ``dst`` for every node."""
    from papyrine.operators.vectors import knn

    links = knn(df, ident, vector, neighbours).select("src", "dst", F.sqrt("d2").alias("d"))
    return links.unionByName(df.select(F.col(ident).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(-1.0).alias("d")))


def place(pdf: pd.DataFrame, components: int, neighbours: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of ``umap_links`` in ascending order and their places."""
    own = np.sort(pdf.loc[pdf["d"] < 0, "src"].unique())
    e = pdf[pdf["d"] >= 0].sort_values(["src", "d", "dst"])
    if len(own) < 2 or not len(e):
        return own, np.zeros((len(own), components))
    s, t = np.searchsorted(own, e["src"].to_numpy()), np.searchsorted(own, e["dst"].to_numpy(dtype="int64"))
    a, b, w = fuzzy_weights(len(own), s, t, e["d"].to_numpy(), neighbours)
    return own, embed_neighbours(len(own), a, b, w, components, epochs, seed)


def umap(df: DataFrame, ident: str, vector: str, components: int = 3, neighbours: int = 15, epochs: int = 200, seed: int = 42) -> DataFrame:
    """``(ident, vec)``: neighbours are found in blocks over the cluster; the placement is one task with the rows' links, no vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, y = place(pdf, components, neighbours, epochs, seed)
        return pd.DataFrame({"node": own, "vec": list(y)})

    return umap_links(df, ident, vector, neighbours).groupBy().applyInPandas(run, "node long, vec array<double>").select(F.col("node").alias(ident), "vec")


def reduce(method: str, df: DataFrame, ident: str, vector: str, **params) -> DataFrame:
    """``(ident, vec)`` by a registered method."""
    if method == "identity":
        return df.select(ident, F.col(vector).cast("array<double>").alias("vec"))
    if method == "pca":
        return pca(df, ident, vector, params.get("components", 50))[0]
    if method == "umap":
        return umap(df, ident, vector, **params)
    raise KeyError(f"no method {method!r}")
