"""A seeded mixture of Gaussian groups, for trials without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.functions.rng import generator, normal

HALF_SIDE = 60.0
NODES = "node_id long, origin_id int, t double, base_pos array<double>"
ORIGINS = "id int, centre array<double>, spread array<double>"


def mixture(spark: SparkSession, seed: int = 42, nodes: int = 400, origins: int = 6, spread_scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and origins. Centres lie in a cube, deviations are 7 to 25 % of its half side, every origin has a node, the others go by drawn weights.

    Numbers are drawn in sequence on the driver: this is for some thousand nodes.
    """
    rng = generator(seed)
    nodes = max(1, int(nodes))
    k = max(1, min(nodes, int(origins)))
    made = []
    for i in range(k):
        centre = [HALF_SIDE * (2 * rng() - 1) for _ in range(3)]
        made.append((i, centre, [HALF_SIDE * (0.07 + 0.18 * rng()) * spread_scale for _ in range(3)]))
    counts = [1] * k
    if nodes > k:
        weights = [0.4 + rng() for _ in range(k)]
        for _ in range(nodes - k):
            at, left = 0, rng() * sum(weights)
            while at < k - 1 and left > weights[at]:
                left -= weights[at]
                at += 1
            counts[at] += 1
    rows = []
    for (i, centre, spread), n in zip(made, counts, strict=True):
        for _ in range(n):
            g = [normal(rng) for _ in range(3)]
            t = rng()
            rows.append((len(rows), i, t, [c + s * x for c, s, x in zip(centre, spread, g, strict=True)]))
    return spark.createDataFrame(rows, NODES), spark.createDataFrame(made, ORIGINS)
