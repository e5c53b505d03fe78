"""Two partitions of the same nodes compared: as a whole, cluster by cluster, node by node."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import metrics
from papyrine.session import cut


def _matched(table: DataFrame) -> DataFrame:
    """``(a, matched, jaccard)``: clusters matched one to one for the largest total Jaccard; sizes count all members, noise is matched with nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (ra, a), (rb, b), n = np.unique(pdf["a"], return_inverse=True), np.unique(pdf["b"], return_inverse=True), pdf["n"].to_numpy(dtype=float)
        j = n / (np.bincount(a, n)[a] + np.bincount(b, n)[b] - n)
        real = (ra[a] >= 0) & (rb[b] >= 0)
        a, b, j = a[real], b[real], j[real]
        pick = dict(metrics.matching(a, b, j))
        score = {r: w for r, c, w in zip(a.tolist(), b.tolist(), j.tolist(), strict=True) if pick.get(r) == c}
        own = np.flatnonzero(ra >= 0).tolist()
        return pd.DataFrame({"a": ra[own], "matched": [int(rb[pick[i]]) if i in pick else -1 for i in own], "jaccard": [score.get(i, 0.0) for i in own]})

    # One table of the size of the partitions, not of the nodes.
    return table.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf), "a long, matched long, jaccard double")


class Comparison:
    """``table`` (a, b, n); ``moves`` (a, size, biggest, biggest_count); ``clusters`` (a, matched, jaccard, size, retained, lost, biggest, biggest_count); ``nodes`` (node_id, a, b, retention); ``summary``; ``aggregate``.

    Clusters are matched only where that is asked for: by ``clusters``, and by ``aggregate`` for its macro average.
    """

    def __init__(self, pre: DataFrame, post: DataFrame):
        a, b = pre.select("node_id", F.col("node_cluster").alias("a")), post.select("node_id", F.col("node_cluster").alias("b"))
        both = cut(a.join(b, "node_id"))  # used by the table and by the nodes; the clusters may be costly
        self.table = cut(both.groupBy("a", "b").agg(F.count("*").alias("n")))
        sizes = Window.partitionBy("a")
        t = self.table.withColumn("size", F.sum("n").over(sizes))
        # Where most members went; noise only if all went there.
        order = sizes.orderBy((F.col("b") >= 0).desc(), F.desc("n"), "b")
        self.moves = t.withColumn("r", F.row_number().over(order)).filter("r = 1 and a >= 0").select(F.col("a").cast("long").alias("a"), "size", F.col("b").alias("biggest"), F.col("n").alias("biggest_count"))
        retention = F.when((F.col("a") < 0) | (F.col("b") < 0), F.lit(None).cast("double")).when(F.col("size") <= 1, 1.0).otherwise((F.col("n") - 1) / (F.col("size") - 1))
        self.nodes = both.join(t, ["a", "b"]).select("node_id", "a", "b", retention.alias("retention"))

    @cached_property
    def clusters(self) -> DataFrame:
        kept = self.table.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("matched"), F.col("n").alias("retained"))
        c = self.moves.join(cut(_matched(self.table)), "a").join(kept, ["a", "matched"], "left").fillna(0, ["retained"])
        return c.select("a", "matched", "jaccard", "size", "retained", (F.col("size") - F.col("retained")).alias("lost"), "biggest", "biggest_count")

    @property
    def summary(self) -> DataFrame:
        """``(n, ari, nmi, nmi_geometric, clusters_pre, clusters_post, noise_pre, noise_post, reorganised)``, one row."""
        share = lambda c: F.sum(F.when(F.col(c) < 0, F.col("n")).otherwise(0)) / F.sum("n")
        number = lambda c: F.countDistinct(F.when(F.col(c) >= 0, F.col(c)))
        parts = self.table.agg(number("a").alias("clusters_pre"), number("b").alias("clusters_post"), share("a").alias("noise_pre"), share("b").alias("noise_post"))
        moved = self.nodes.agg(F.count_if(F.col("retention") < 0.5).alias("reorganised"))
        return metrics.scores(self.table).crossJoin(parts).crossJoin(moved)  # one row each

    @property
    def aggregate(self) -> DataFrame:
        """``summary`` and ``macro``, the mean matched Jaccard by size; one row."""
        macro = self.clusters.agg((F.sum(F.col("jaccard") * F.col("size")) / F.sum("size")).alias("macro"))
        return self.summary.crossJoin(macro)  # one row each

    def top_movers(self, most: int = 20) -> DataFrame:
        return self.nodes.filter("retention is not null").orderBy("retention", "node_id").limit(most)


def compare(pre: DataFrame, post: DataFrame) -> Comparison:
    """Comparison of two partitions ``(node_id, node_cluster)``; nodes that only one of them has take no part."""
    return Comparison(pre, post)


def compare_levels(assign: DataFrame, levels: DataFrame) -> dict[str, Comparison]:
    """Every level against the next finer one, by the name of the finer."""
    names = [(r["level_uid"], r["level_no"]) for r in levels.orderBy("level_no").collect()]  # a handful of levels
    of = lambda uid: assign.filter(F.col("level_uid") == uid).select("node_id", "node_cluster")
    return {fine[0]: compare(of(coarse[0]), of(fine[0])) for coarse, fine in zip(names, names[1:], strict=False)}
