"""Bibliographic exports, cart files, projects and method notes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import strip
from papyrine.sources.corpus import author_list

#: Record types of the RIS format by kind of publication.
RIS_TYPES = {
    "journalarticle": "JOUR", "article": "JOUR", "preprint": "JOUR", "conferencepaper": "CONF", "proceedings": "CONF", "book": "BOOK", "bookchapter": "CHAP",
    "chapter": "CHAP", "review": "JOUR", "dataset": "DATA", "report": "RPRT", "thesis": "THES", "dissertation": "THES", "patent": "PAT",
}


def ris_type(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RIS_TYPES.items() for x in kv)), F.lower(kind)), F.lit("GEN"))


def ris_record(authors: Column, title: Column, year: Column, venue: Column, doi: Column, kind: Column, abstract: Column | None = None, note: Column | None = None) -> Column:
    """One record: a line ``TAG  - value`` each, line breaks within values closed up, empty fields left out."""
    flat = lambda c: strip(F.regexp_replace(c.cast("string"), r"\s*\r?\n\s*", " "))
    line = lambda tag, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{tag}  - "), flat(c)))
    names = F.transform(author_list(authors), lambda a: F.concat(F.lit("AU  - "), flat(a)))
    lines = [F.concat(F.lit("TY  - "), ris_type(kind)), F.when(F.size(names) > 0, F.array_join(names, "\n")), line("TI", title), line("PY", year), line("JO", venue), line("DO", doi)]
    lines += [line("AB", abstract)] if abstract is not None else []
    lines += [line("N1", note)] if note is not None else []
    return F.concat_ws("\n", *lines, F.lit("ER  - "))


def write_ris(records: DataFrame, path: str) -> None:
    """Files of records with a blank line between them, in the order of ``ord`` within and across files; one file for each range of it."""
    records.filter("record is not null").repartitionByRange("ord").sortWithinPartitions("ord").select(F.concat("record", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def ris_text(records: DataFrame) -> str:
    """One text of a selection that fits the driver, such as a user's cart."""
    parts = [r["record"] for r in records.filter("record is not null").orderBy("ord").select("record").collect()]
    return "\n\n".join(parts) + "\n" if parts else ""


def selection_records(selected: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records ``(node_id, record)`` of selected nodes, and ``(count, missing)``."""
    j = selected.join(records, "node_id", "left")
    return j.filter("record is not null"), j.agg(F.count("record").alias("count"), F.count_if(F.col("record").isNull()).alias("missing"))


def filename(level: str, score: int | None = None, cluster: int | None = None, extension: str = "ris") -> str:
    return f"{level}-{'cluster-' + str(cluster) if cluster is not None else 'score-' + str(score) + '-up'}.{extension}"


def cart_json(cart: DataFrame) -> DataFrame:
    """``(json)``: {"papers": [{id, source}]}, a cart being what a user has collected."""
    papers = F.transform(F.array_sort(F.collect_list(F.struct("paper_id", "source"))), lambda p: F.struct(p["paper_id"].alias("id"), p["source"].alias("source")))
    return cart.agg(F.to_json(F.struct(papers.alias("papers"))).alias("json"))


SCHEMA_VERSION = 1


def save_project(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """Every table as Parquet, the settings and the list of tables as a manifest, written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"schema_version": SCHEMA_VERSION, "tables": sorted(tables), "settings": settings}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"a project of version {manifest.get('schema_version')} can't be read")
    return {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]}, manifest["settings"]


def receipt(method: str, params: dict, sweep: DataFrame | None = None, bootstrap: DataFrame | None = None) -> str:
    """A paragraph on how a result came about."""
    text = [f"Clusters were found with {method} ({', '.join(f'{k} = {v}' for k, v in sorted(params.items()))})."]
    if sweep is not None:
        r = sweep.agg(F.count("*").alias("n"), F.min("clusters").alias("lo"), F.max("clusters").alias("hi"), F.expr("percentile(clusters, 0.5)").alias("mid"), F.avg("clusters").alias("mean"), F.stddev_pop("clusters").alias("sd")).first()
        text.append(f"{r['n']} settings gave {r['lo']} to {r['hi']} clusters (median {r['mid']:g}, mean {r['mean']:.1f}, standard deviation {r['sd']:.1f}).")
    if bootstrap is not None:
        from papyrine.operators.clustering import stability_summary

        r = stability_summary(bootstrap).first()
        text.append(f"On subsamples clusters came back with a mean Jaccard of {r['macro']:.2f} by size and {r['unweighted']:.2f} each; {r['stable']} were stable, {r['doubtful']} doubtful, {r['unstable']} unstable.")
    return " ".join(text)
