"""The rows that count in tables with superseded and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.neighbours import usable
from papyrine.sources.snapshot import assignments as current_assignments

__all__ = ["current_assignments", "latest_positions"]


def latest_positions(nodes: DataFrame, dims: int = 3) -> DataFrame:
    """``(id, v0, ...)`` of the nodes with a usable position in the row that counts (latest ``ingested_at``)."""
    rows = nodes.select("node_id", "ingested_at", F.col("base_pos").cast("array<double>").alias("base_pos"))
    last = rows.groupBy("node_id").agg(F.max(F.struct("ingested_at", "base_pos"))["base_pos"].alias("base_pos"))
    return usable(last, "node_id", "base_pos", dims)
