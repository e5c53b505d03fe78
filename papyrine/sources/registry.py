"""Sources of nodes, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources import matrix, mixture, npy, snapshot


@dataclass(frozen=True)
class Source:
    name: str
    label: str
    defaults: dict
    read: Callable[[SparkSession, dict], dict[str, DataFrame]]


def _toy(spark, p):
    nodes, origins = mixture.mixture(spark, p["seed"], p["nodes"], p["origins"], p["spread_scale"])
    from papyrine.operators import clustering, metrics

    # How well the origins can be told from the positions at all.
    best = clustering.bayes_labels(nodes, origins).select("node_id", F.col("origin").alias("b"))
    limit = metrics.scores(metrics.contingency(nodes.select("node_id", F.col("origin_id").alias("a")), best)).select("n", "ari")
    return {"nodes": nodes, "origins": origins, "bayes": limit}


def _tables(spark, p):
    from papyrine.session import table

    nodes = snapshot.nodes(table(spark, p["path"], "nodes"))
    return {"nodes": nodes, "edges": snapshot.node_edges(table(spark, p["path"], "citations"), nodes)}


def _matrix(spark, p):
    return {"embeddings": npy.read_npy(spark, p["path"])}


def _subset(spark, p):
    return matrix.read(spark, p["matrix"], p["index"], p["years"], p["edges"])


SOURCES = {
    s.name: s
    for s in (
        Source("toy", "Gaussian mixture", {"seed": 42, "nodes": 400, "origins": 6, "spread_scale": 1.0}, _toy),
        Source("tables", "Parquet tables of nodes and citations", {"path": None}, _tables),
        Source("matrix", "NPY matrix", {"path": None}, _matrix),
        Source("subset", "NPY matrix with its papers, years and links", {"matrix": None, "index": None, "years": None, "edges": None}, _subset),
    )
}


def get(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(SOURCES)}")
    return SOURCES[name]


def read(spark: SparkSession, name: str, **params) -> dict[str, DataFrame]:
    source = get(name)
    unknown = set(params) - set(source.defaults)
    if unknown:
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return source.read(spark, source.defaults | params)
