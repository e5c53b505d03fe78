"""Importers of citation links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IMPORTERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def importer(name: str):
    def put(f):
        _IMPORTERS[name] = f
        return f

    return put


def get_importer(name: str):
    if name not in _IMPORTERS:
        raise KeyError(f"no importer {name!r}; there are {', '.join(sorted(_IMPORTERS))}")
    return _IMPORTERS[name]


@importer("json")
def from_json(spark: SparkSession, params: dict) -> DataFrame:
    """``(src, dst)`` of a JSON document ``{"edges": [[src, dst], ...]}``."""
    doc = spark.read.schema("edges array<array<long>>").json(params["path"], multiLine=True)
    return doc.select(F.explode("edges").alias("e")).select(F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"))


@importer("parquet")
def from_parquet(spark: SparkSession, params: dict) -> DataFrame:
    return spark.read.parquet(params["path"]).select(F.col(params.get("src", "citing_id")).alias("src"), F.col(params.get("dst", "cited_id")).alias("dst"))


def materialise(citations: DataFrame) -> DataFrame:
    """``(citing_id, cited_id)``: of all rows between two papers, in either direction, the first discovered."""
    c = citations.filter("citing_id is not null and cited_id is not null and citing_id <> cited_id")
    pair = [F.least("citing_id", "cited_id").alias("a"), F.greatest("citing_id", "cited_id").alias("b")]
    first = c.groupBy(*pair).agg(F.min(F.struct(F.col("discovered").isNotNull(), "discovered", F.col("arrived_at").isNotNull(), "arrived_at", "citing_id", "cited_id")).alias("f"))
    return first.select("f.citing_id", "f.cited_id")


def citing_to_cited(edges: DataFrame) -> DataFrame:
    """Links stored as cited → citing, turned."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
