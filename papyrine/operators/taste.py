"""Citations drawn from clusters' tastes: which neighbourhoods cite which, and links that follow."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.rng import generator, poisson, shuffled
from papyrine.operators import space
from papyrine.operators.graph import connected_components
from papyrine.operators.vectors import knn, mutual_pairs
from papyrine.session import cut


#: Where links come from, and what each way needs.
CITATIONS = {
    "taste-network": {"label": "Drawn from tastes", "needs_neighbourhoods": True, "needs_positions": True, "is_async": False, "defaults": {"budget": 1200, "rate_inside": 1.0, "rate_outside": 0.02, "seed": 11}},
    "imported": {"label": "Imported links", "needs_neighbourhoods": False, "needs_positions": False, "is_async": True, "defaults": {}},
}


def citations(method: str, nodes: DataFrame, assign: DataFrame | None = None, positions: DataFrame | None = None, imported: DataFrame | None = None, **given) -> DataFrame:
    """``(src, dst)`` by a registered way: each link once, no node with itself, both ends known. Raises if what the way needs is missing."""
    if method not in CITATIONS:
        raise KeyError(f"no way {method!r}; there are {', '.join(CITATIONS)}")
    way = CITATIONS[method]
    if unknown := set(given) - set(way["defaults"]):
        raise TypeError(f"{method} has no parameter {', '.join(sorted(unknown))}")
    params = way["defaults"] | given
    if method == "imported":
        if imported is None:
            raise ValueError("there are no links to import")
        links = imported.select("src", "dst")
    else:
        if assign is None or positions is None:
            raise ValueError(f"{method} needs clusters and positions")
        near = cut(neighbourhoods(positions, assign))
        centres = near.join(positions, "node_id").groupBy("neighbourhood").agg(*(F.avg(c).alias(c) for c in "xyz")).orderBy("neighbourhood")
        likes = tastes([(r["neighbourhood"], r["x"], r["y"], r["z"]) for r in centres.collect()])  # drawn on the driver for some hundred neighbourhoods
        pairs = nodes.sparkSession.createDataFrame([(a, b) for a, s in likes.items() for b in s], "neighbourhood long, cites long")
        links = draw_links(near.join(nodes.select("node_id", "t"), "node_id"), pairs, **params)
    known = nodes.select("node_id")
    links = links.filter("src is not null and dst is not null and src <> dst").distinct()
    return links.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def of_clusters(taste: DataFrame, members: DataFrame) -> DataFrame:
    """``(node_cluster, cites)``: the tastes of all neighbourhoods of a cluster together; ``members``: (neighbourhood, node_cluster)."""
    return members.select("neighbourhood", "node_cluster").distinct().join(taste, "neighbourhood").select("node_cluster", "cites").distinct()


def neighbourhoods(pos: DataFrame, assign: DataFrame, k: int = 4) -> DataFrame:
    """``(node_id, node_cluster, neighbourhood)``: components of mutual nearest neighbours within clusters, named by their smallest node."""
    rows = assign.filter("node_cluster >= 0").join(pos, "node_id").select("node_id", "node_cluster", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    p = cut(rows.withColumn("times", F.count("*").over(Window.partitionBy("node_id"))))
    if (p.agg(F.max("times")).first()[0] or 0) > 1:  # nodes in several clusters tie these together
        return _tied(p.select("node_id", "node_cluster", F.array("x", "y", "z").alias("v")), k)
    fine = F.coalesce(reduce(lambda a, b: a & b, (~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz")), F.lit(False))
    own = p.select(F.col("node_id").cast("long").alias("id"), F.col("node_cluster").alias("grp"), *"xyz")
    placed = space.mutual_components(own.filter(fine), ["x", "y", "z"], k, 16384, 9)
    near = placed.unionByName(own.filter(~fine).select("id", "grp", F.col("id").alias("component")))
    return near.select(F.col("id").alias("node_id"), F.col("grp").alias("node_cluster"), F.col("component").alias("neighbourhood"))


def _tied(p: DataFrame, k: int) -> DataFrame:
    mutual = mutual_pairs(knn(p, "node_id", "v", k, by="node_cluster"))
    own = p.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    comp = connected_components(mutual.unionByName(own))
    return comp.join(p.select(F.col("node_id").alias("id"), "node_cluster"), "id").select(F.col("id").alias("node_id"), "node_cluster", F.col("component").alias("neighbourhood"))


def tastes(centroids: list[tuple[int, float, float, float]], mean_size: float = 2.0, reach: float = 0.35, seed: int = 7) -> dict[int, set[int]]:
    """For each neighbourhood the neighbourhoods it cites: a drawn number of them, the nearer the likelier; drawn on the driver for some hundred neighbourhoods.

    A last pass exchanges a link for one that closes a triangle, where a third neighbourhood cites both.
    """
    rng = generator(seed)
    span = max((math.dist(a[1:], b[1:]) for a in centroids for b in centroids), default=1.0) or 1.0
    out: dict[int, set[int]] = {}
    for me in centroids:
        others = shuffled([c for c in centroids if c[0] != me[0]], rng)
        kernel = {c[0]: math.exp(-((math.dist(me[1:], c[1:]) / (reach * span)) ** 2)) for c in others}
        size, chosen = min(len(others), poisson(mean_size, rng)), set()
        while len(chosen) < size:
            left = [c[0] for c in others if c[0] not in chosen]
            at, x = 0, rng() * sum(kernel[c] for c in left)
            while at < len(left) - 1 and x > kernel[left[at]]:
                x -= kernel[left[at]]
                at += 1
            chosen.add(left[at])
        out[me[0]] = chosen | {me[0]}
    shared = {(a, b): sum(1 for s in out.values() if a in s and b in s) for a in out for b in out if a != b}
    for me in sorted(out):
        inside, outside = sorted(out[me] - {me}), sorted(set(out) - out[me])
        if inside and outside:
            worst, best = min(inside, key=lambda c: (shared[me, c], c)), max(outside, key=lambda c: (shared[me, c], -c))
            if shared[me, best] > shared[me, worst]:
                out[me] = out[me] - {worst} | {best}
    return out


def draw_links(nodes: DataFrame, taste: DataFrame, budget: int, rate_inside: float = 1.0, rate_outside: float = 0.02, seed: int = 11) -> DataFrame:
    """``(src, dst)``: links from newer to older nodes, ``t`` being larger for newer ones, drawn independently so that about ``budget`` come out.

    ``nodes``: (node_id, neighbourhood, t); ``taste``: (neighbourhood, cites). A pair is drawn by a seeded hash, whatever the partitioning. Pairs within a taste come from an
    equi-join; of the others, for which all pairs would be needed, every node draws its few partners directly.
    """
    a = nodes.select(F.col("node_id").alias("src"), F.col("neighbourhood"), F.col("t").alias("ts"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("neighbourhood").alias("cites"), F.col("t").alias("td"))
    inside = a.join(taste, "neighbourhood").join(b, "cites").filter("ts > td").select("src", "dst")
    n_in = inside.count()
    n = nodes.count()
    total = n * (n - 1) / 2
    scale = budget / max(1e-9, rate_inside * n_in + rate_outside * max(0.0, total - n_in))
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    kept = inside.filter(unit("src", "dst") < min(1.0, scale * rate_inside))
    want = scale * rate_outside * max(0.0, total - n_in) / max(1, n)
    whole = int(want) + 1
    numbered = nodes.select(F.col("node_id").alias("dst"), F.col("t").alias("td"), F.pmod(F.xxhash64("node_id"), F.lit(max(1, n))).alias("slot"))
    asked = a.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(whole)))).filter(unit("src", "i") < want / whole).withColumn("slot", F.pmod(F.xxhash64("src", "i", F.lit(seed)), F.lit(max(1, n))))
    far = asked.join(numbered, "slot").filter("ts > td").select("src", "dst")
    return kept.unionByName(far).distinct()
