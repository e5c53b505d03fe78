"""The domain tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.session import table
from papyrine.sources import snapshot


class Domain:
    """Cleaned tables of one directory; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def nodes(self) -> DataFrame:
        return snapshot.nodes(self.raw("nodes"))

    @property
    def positions(self) -> DataFrame:
        return snapshot.positions(self.raw("nodes"))

    @property
    def assign(self) -> DataFrame:
        return snapshot.assignments(self.raw("cluster_nodes"))

    @property
    def levels(self) -> DataFrame:
        return self.raw("level_info")

    @property
    def edges(self) -> DataFrame:
        return snapshot.edges(self.raw("citations"))

    @property
    def node_edges(self) -> DataFrame:
        return snapshot.node_edges(self.raw("citations"), self.nodes)

    @property
    def cart(self) -> DataFrame:
        return self.raw("cart")

    def level(self, number: int) -> DataFrame:
        """Of the raw rows only the level's own are grouped."""
        one = self.levels.filter(F.col("level_no") == number).select("level_uid")
        own = self.raw("cluster_nodes").join(F.broadcast(one), "level_uid", "left_semi")
        return snapshot.assignments(own).join(F.broadcast(one), "level_uid").select("node_id", "node_cluster")

    @property
    def scores(self) -> DataFrame:
        """Scores 1 to 5 of every cluster, from its number and level (the tables hold none)."""
        a = self.assign.filter("node_cluster >= 0").select("level_uid", "node_cluster").distinct().join(self.levels.select("level_uid", "level_no"), "level_uid")
        return a.select("level_uid", "level_no", "node_cluster", (1 + (F.col("node_cluster") + F.col("level_no")) % 5).alias("score"))


#: The scores in SQL; needs ``leveled``.
SCORES = "scores AS (SELECT DISTINCT level_uid, level_no, node_cluster, 1 + (node_cluster + level_no) % 5 AS score FROM leveled WHERE node_cluster >= 0)"
