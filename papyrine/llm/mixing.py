"""Selecting records so that sources contribute target shares, by thresholds on a hash.

A mix has a budget. ``match``, the rule: the largest budget at which every source that has anything meets its share within its repeats, at most the tokens of all records of
the mix's sources. ``all``: just those tokens; a source short of records then gives what its repeats allow and the others keep their share of the budget. Or a number.

A source's quota is its share of the budget, at most ``max_repeats`` times what it has. All its records are used as often as whole repeats fit into the quota; the rest is filled
once more by the records whose hash lies below a threshold. Thresholds come from nested histograms: tokens are summed once by source and leading bits of the hash, as many bits as
leave some ``bucket_rows`` records of the largest source in a bucket; the bucket in which the rest runs out is found from coarse to fine by adding those sums up, and only
the records of that last bucket are looked at one by one: in the order of their hash those that fit into the rest go in, and one more that is too large if it misses the quota by less. A
filter then selects everything else. No records are sorted but those of the boundary buckets.

Defined results: records without source or identifier take no part, nor do targets without name, source or share; a null or negative number of
repeats counts as 0; of repeated targets the shares add up and the most repeats count; a source without records, or with 0 repeats, contributes nothing, is reported with share 0 and
doesn't bound the budget. A repeated identifier is a record each time. Records of no tokens follow the threshold. Empty tables give an empty selection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import cut

_KEY_BITS, _LEVEL_BITS = 36, 12


def fill(tokens: np.ndarray, rest: int) -> np.ndarray:
    """Which records, in their order, go into ``rest`` tokens."""
    taken = np.cumsum(tokens) <= rest
    first = int(taken.argmin()) if len(taken) and not taken.all() else len(taken)
    taken[first:] = False
    left = rest - int(tokens[:first].sum())
    for i in np.flatnonzero(tokens[first:] <= left).tolist() if left > 0 else ():
        if tokens[first + i] <= left:
            taken[first + i] = True
            left -= int(tokens[first + i])
    over = np.where(taken, np.iinfo(np.int64).max, tokens - left)  # what a further record would be too much
    if left > 0 and len(over) and over.min() < left:
        taken[int(over.argmin())] = True
    return taken


def mix(records: DataFrame, targets: DataFrame, budget: str | int | Sequence[str | int] = "match", bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """For ``(id, source, tokens)`` and ``(mix_name, source, target_share, max_repeats)``: the selection ``(budget, mix_name, id, source, tokens, copies)``
    and the report ``(budget, mix_name, source, target_share, available, quota, tokens, share_of_budget, share_reached, most_copies)``, for each of the budgets asked."""
    rules = [str(b) for b in ([budget] if isinstance(budget, (str, int)) else budget)]
    spark = records.sparkSession
    key = F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 64 - _KEY_BITS)
    docs = cut(records.filter("id is not null and source is not null").select("id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), key.alias("key")))
    have = cut(docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n")))
    most = have.agg(F.max("n")).first()[0] or 0
    bits = min(_KEY_BITS, max(0, int(np.ceil(np.log2(max(1.0, most / bucket_rows))))))
    docs = docs.select("id", "source", "tokens", "key", (F.shiftright("key", _KEY_BITS - bits) if bits else F.lit(0).cast("long")).alias("bucket"))

    want = targets.filter("mix_name is not null and source is not null and target_share is not null")
    want = want.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.lit(0), F.coalesce(F.max("max_repeats"), F.lit(0))).alias("max_repeats"))
    want = want.join(spark.createDataFrame([(r,) for r in rules], "budget string"))  # one row a budget
    need = want.join(have, "source", "left").fillna(0, ["available", "n"])
    whole_mix = Window.partitionBy("budget", "mix_name")
    limit = F.col("max_repeats") * F.col("available") / F.col("target_share")
    meets = F.min(F.when((F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0), limit)).over(whole_mix)
    total = F.sum("available").over(whole_mix)
    tokens = F.when(F.col("budget") == "match", F.least(F.coalesce(meets, F.lit(0.0)), total.cast("double"))).when(F.col("budget") == "all", total.cast("double")).otherwise(F.expr("try_cast(budget as double)"))
    need = need.withColumn("of", tokens).withColumn("quota", F.least(F.floor(F.col("target_share") * F.col("of") + 0.5), F.col("max_repeats") * F.col("available")).cast("long"))
    need = need.withColumn("whole", F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0).cast("int"))
    need = cut(need.withColumn("rest", (F.col("quota") - F.col("whole") * F.col("available")).cast("long")))

    sums = cut(docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum")))
    names = ["budget", "mix_name", "source"]
    open_ = need.filter("rest > 0").select(*names, F.lit(0).cast("long").alias("prefix"), "rest")
    done = 0
    while True:  # from the leading bits to all of them
        step = min(_LEVEL_BITS, bits - done)
        shift = bits - done - step
        inside = sums.join(open_, "source").filter(F.shiftright("bucket", shift + step) == F.col("prefix"))
        level = inside.groupBy(*names, "rest", F.shiftright("bucket", shift).alias("at")).agg(F.sum("sum").alias("sum"))
        run = level.withColumn("to", F.sum("sum").over(Window.partitionBy(*names).orderBy("at")))
        open_ = cut(run.filter("to > rest and to - sum <= rest").select(*names, F.col("at").alias("prefix"), (F.col("rest") - F.col("to") + F.col("sum")).alias("rest")))
        done += step
        if done >= bits:
            break

    # With every bucket below the last one in, its own records are looked at.
    plan = need.join(open_.select(*names, F.col("prefix").alias("last"), F.col("rest").alias("room")), names, "left")
    plan = cut(plan.select("*", F.least("max_repeats", F.col("whole") + 1).cast("int").alias("most")))
    both = docs.join(plan.select(*names, "whole", "most", "last", "room"), "source")

    def look(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "id", "tokens"], kind="stable")
        taken = fill(group["tokens"].to_numpy(), int(group["room"].iloc[0]))
        return group.assign(copies=np.where(taken, group["most"], group["whole"]))[["budget", "mix_name", "id", "source", "tokens", "copies"]]

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    out = f"budget string, mix_name {kinds['mix_name']}, id {kinds['id']}, source {kinds['source']}, tokens long, copies int"
    looked = both.filter("bucket = last").groupBy(*names).applyInPandas(look, out)
    rest = both.filter("last is null or bucket <> last").select(*names[:2], "id", "source", "tokens", F.when(F.col("bucket") < F.col("last"), F.col("most")).otherwise(F.col("whole")).cast("int").alias("copies"))
    chosen = looked.unionByName(rest).filter("copies > 0")

    got = chosen.groupBy(*names).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = plan.join(got, names, "left").fillna(0, ["tokens", "most_copies"])
    all_ = F.sum("tokens").over(whole_mix)
    share = F.when(all_ > 0, F.round(F.col("tokens") / all_, 6)).otherwise(0.0)
    of_budget = F.when(F.col("of") > 0, F.round(F.col("tokens") / F.col("of"), 6)).otherwise(0.0)
    report = report.select(*names, "target_share", "available", "quota", "tokens", of_budget.alias("share_of_budget"), share.alias("share_reached"), "most_copies")
    return chosen, report
