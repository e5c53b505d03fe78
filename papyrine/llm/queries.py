"""Queries of the operators of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import cleaning, density, exact_copies, language, mixing, names, neighbours, packing, tokens, topn
from papyrine.session import cut, table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cluster(cleaning.latest_positions(table(spark, sf_dir, "nodes")), dims=3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.chain(_groups(spark, sf_dir))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its size, its three most typical nodes and the run label most of its members carry, with that label's share."""
    rows = _groups(spark, sf_dir)
    labels = cleaning.current_assignments(table(spark, sf_dir, "cluster_nodes"))
    counts = rows.join(labels, "node_id").groupBy("cluster", "level_uid", "node_cluster").agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster").agg(F.max(F.struct("n", F.col("level_uid").alias("label_level"), F.col("node_cluster").alias("label"))).alias("b"))
    out = density.summaries(rows).join(best, "cluster", "left")
    return out.select("cluster", "size", F.array_join(F.col("exemplars").cast("array<string>"), ",").alias("exemplars"), "b.label_level", "b.label", F.round(F.col("b.n") / F.col("size"), 6).alias("label_share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(names.variants(table(spark, sf_dir, "cart")))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct spelling with the entity it belongs to, named by the entity's smallest spelling, and the number of its other spellings."""
    found = names.variants(table(spark, sf_dir, "cart"))
    size = found.groupBy("kind", "entity").agg(F.min("spelling").alias("entity_name"), (F.count("*") - 1).alias("links"))
    return found.join(size, ["kind", "entity"]).select("kind", "spelling", "entity_name", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = cleaning.current_assignments(table(spark, sf_dir, "cluster_nodes")).filter("node_cluster <> -1")
    cart = table(spark, sf_dir, "cart").filter("node_id is not null and in_deg is not null")
    degree = cart.groupBy("node_id").agg(F.max("in_deg").alias("in_deg"))
    scored = assigned.join(degree, "node_id").select("level_uid", "node_cluster", "node_id", "in_deg")
    return topn.top_n(scored, ["level_uid", "node_cluster"], "in_deg", "node_id", 5).drop("in_deg")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.encode(table(spark, sf_dir, "cart"), "row_id", ["title", "doi"], required=["title"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.copies(_encoded(spark, sf_dir))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.records(_encoded(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cleaning.latest_positions(table(spark, sf_dir, "nodes"))
    return neighbours.pairs(points, neighbours.nearest(points, k=5, dims=3))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = [(r["bin_name"], r["capacity_tokens"]) for r in table(spark, sf_dir, "token_bins").collect()]  # a fixed table of three rows
    return packing.pack(cut(_sizes(spark, sf_dir).select("id", "tokens")), bins)


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id")


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(_packed(spark, sf_dir), table(spark, sf_dir, "token_bins"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return chosen.drop("budget").withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached with the largest budget that meets them (``match``, that of p7_mix) and with all tokens (``all``)."""
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), ("match", "all"))[1]


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    state = language.state_of(spark, f"{sf_dir}/lang_samples.parquet", f"{sf_dir}/documents.parquet")
    return language.detect(documents, language.trained(table(spark, sf_dir, "lang_samples"), documents, state))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cases(_languages(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(_languages(spark, sf_dir))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p6_pack": p6_pack, "p6_usage": p6_usage, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments}
