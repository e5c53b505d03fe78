"""A subset in files: a matrix, the papers of its rows, and on request years and links."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.session import cut
from papyrine.sources.corpus import normalised_time
from papyrine.sources.npy import read_npy


def _entries(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    """Rows that ``parse`` makes of a JSON document; each file is parsed in one task."""

    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                rows = parse(json.loads(text))
                for s in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[s : s + 10_000], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.option("wholetext", True).text(path).mapInPandas(run, schema)


def _listed(doc) -> list[tuple]:
    return [(int(k), v) for k, v in (doc.items() if isinstance(doc, dict) else enumerate(doc))]


def _id(v) -> int:
    return int(v["id"] if isinstance(v, dict) else v)


def read(spark: SparkSession, matrix: str, index: str, years: str | None = None, edges: str | None = None) -> dict[str, DataFrame]:
    """``nodes`` (node_id, paper_id, year, t, structural), ``vectors`` (node_id, vec) and ``edges`` (src, dst).

    The index is an array, or an object from row to entry; an entry is a paper or ``{id, structural}``. Years are an object from row to year; without any every ``t`` is that of unknown years. Links are pairs of rows, the first cited by the
    second; those with an end outside the matrix are dropped. Rows become ``node_id`` in the index' order without gaps. Raises if a row of the index isn't in the matrix.
    """
    rows = _entries(spark, index, "row_no long, paper_id long, structural boolean", lambda d: [(r, _id(v), bool(v.get("structural")) if isinstance(v, dict) else False) for r, v in _listed(d)])
    from papyrine.operators.numbering import numbered

    rows = cut(numbered(rows, "row_no", "node_id"))
    m = read_npy(spark, matrix)
    missing = rows.join(m.select("row_no"), "row_no", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows of the index aren't in the matrix")
    if years:
        y = _entries(spark, years, "row_no long, year int", lambda d: [(r, None if v is None else int(v)) for r, v in _listed(d)])
        nodes = rows.join(y, "row_no", "left")
    else:
        nodes = rows.withColumn("year", F.lit(None).cast("int"))
    out = {"nodes": normalised_time(nodes.drop("row_no")), "vectors": m.join(rows.select("row_no", "node_id"), "row_no").select("node_id", "vec")}
    if edges:
        e = _entries(spark, edges, "cited long, citing long", lambda d: [(int(a), int(b)) for a, b in d])
        at = rows.select("row_no", "node_id")
        out["edges"] = e.join(at.toDF("citing", "src"), "citing").join(at.toDF("cited", "dst"), "cited").filter("src <> dst").select("src", "dst").distinct()
    else:
        out["edges"] = spark.createDataFrame([], "src long, dst long")
    return out
