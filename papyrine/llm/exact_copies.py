"""Records that are equal but for formatting, by dictionary-encoded columns.

Each distinct raw value is canonicalised once, each distinct canonical value gets an integer identifier, records are
rewritten as sorted tuples of those integers and the compact tuples are grouped.

Canonical form: case folded (``ß`` equals ``SS``), letters and digits only. A null value and one
without letter or digit have identifier 0. With ``ordered=False`` the order of the fields doesn't matter.

Defined results: rows whose required field is null take no part. Repeated rows with one identifier count as copies but
appear once in the pairs, never paired with themselves. A value or record that a third of all rows may share is counted first: those with over a
thousandth of all rows, under a thousand of them, are broadcast (long texts as digests), the rest is shuffled. Very long texts are treated whole. An empty table gives empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators.skew import hot_keys, join_hot
from papyrine.session import cut, exact

_SALTS = 64


def canonical(col: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.upper(F.lower(col))), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


def encode(df: DataFrame, ident: str, fields: Sequence[str], required: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """``(id, key)``: every row with the integer tuple of its fields."""
    src = exact(df, ident, *fields).select(F.col(f"`{ident}`").alias("id"), *(F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    for f in required:
        src = src.filter(F.col(f"f{list(fields).index(f)}").isNotNull())
    values = None
    for k in range(len(fields)):
        part = src.select(F.col(f"f{k}").alias("v")).filter(F.col("v").isNotNull())
        values = part if values is None else values.unionByName(part)
    values = values.groupBy("v").agg(F.count("*").alias("n")).withColumn("c", canonical(F.col("v"))).filter(F.col("c") != "")
    # Identifiers come from positions, which a recomputed stage may hand out anew; hence the cut.
    ids = cut(values.select("c").distinct().select("c", (F.monotonically_increasing_id() + 1).alias("i")))
    lookup = cut(values.join(ids, "c").select("v", "i", "n"))
    hot = lookup.join(F.broadcast(hot_keys(lookup, "v")), "v", "left_semi").select(F.sha2("v", 256).alias("digest"), "i")
    out = src
    for k in range(len(fields)):
        few = F.broadcast(hot.select(F.col("digest").alias(f"d{k}"), F.col("i").alias(f"h{k}")))
        out = out.join(few, F.sha2(f"f{k}", 256) == F.col(f"d{k}"), "left").drop(f"d{k}")
        # Values still to be looked up; the rest is spread, so that nulls and hot values don't meet in one task.
        out = out.withColumn("w", F.when(F.col(f"h{k}").isNull(), F.col(f"f{k}"))).withColumn("salt", F.when(F.col("w").isNull(), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).otherwise(-1))
        side = lookup.select(F.col("v").alias("w2"), F.col("i").alias(f"i{k}"), F.lit(-1).alias("salt2"))
        out = out.join(side, (F.col("w") == F.col("w2")) & (F.col("salt") == F.col("salt2")), "left").withColumn(f"i{k}", F.coalesce(f"h{k}", f"i{k}")).drop(f"f{k}", f"h{k}", "w", "w2", "salt", "salt2")
    key = F.array(*(F.coalesce(F.col(f"i{k}"), F.lit(0)) for k in range(len(fields))))
    return out.select("id", (key if ordered else F.sort_array(key)).alias("key"))


def records(encoded: DataFrame) -> DataFrame:
    """``(record_id, copies)``: one row for each record, the smallest identifier standing for it."""
    return encoded.groupBy("key").agg(F.min("id").alias("record_id"), F.count("*").alias("copies")).select("record_id", "copies")


def copies(encoded: DataFrame) -> DataFrame:
    """``(row_a, row_b)``: each row that isn't its record's smallest, beside that smallest."""
    encoded = cut(encoded)
    groups = encoded.groupBy("key").agg(F.min("id").alias("row_a"), F.max("id").alias("hi"), F.count("*").alias("n"))
    groups = cut(groups)
    found = join_hot(encoded, groups.filter("hi > row_a").select("key", "row_a"), "key", groups.select("key", "n"))
    return found.filter("id > row_a").select("row_a", F.col("id").alias("row_b")).distinct()
