"""Running numbers and sums over values of which there may be as many as rows: by ranges, then by the ranges' offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import cut


def running_sum(df: DataFrame, by: str, value: Column, name: str, descending: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in the order of ``by`` (distinct values).

    Each range of ``by`` is summed up in a task of its own; what lies before it is added, one row a range. The ranges are cut, as they must not change between uses.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    parts = cut(df.withColumn("__value", value).repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    inner = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.groupBy("__range").agg(F.sum("__value").alias("__total"))  # one row a range
    before = whole.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__before"))
    out = parts.withColumn("__sum", F.sum("__value").over(inner)).join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__sum") + F.col("__before")).drop("__value", "__range", "__sum", "__before")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``by`` (distinct values), from 0."""
    return running_sum(df, by, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)
