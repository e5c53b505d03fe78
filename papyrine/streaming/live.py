"""The same results over tables that grow: streams of assignments and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_assignments(stream: DataFrame) -> DataFrame:
    """``(level_uid, node_id, node_cluster, assigned_at)`` of a stream of assignments, for output mode "update": the latest assigned counts.

    The state holds one row for each level and node, however many rows arrive; late rows are welcome, so there is no watermark.
    """
    last = F.max(F.struct("assigned_at", "arrived_at", "node_cluster")).alias("r")
    return stream.filter("node_cluster is not null").groupBy("level_uid", "node_id").agg(last).select("level_uid", "node_id", "r.node_cluster", "r.assigned_at")


def citation_rate(stream: DataFrame, window: str = "30 days", late: str = "90 days") -> DataFrame:
    """``(start, provenance, citations)`` by window of ``discovered``, for output mode "append"; rows later than ``late`` are left out."""
    p = F.coalesce(F.lower(F.trim("provenance")), F.lit("none")).alias("provenance")
    w = stream.withColumn("discovered", F.col("discovered").cast("timestamp")).withWatermark("discovered", late).groupBy(F.window("discovered", window).alias("w"), p).agg(F.count("*").alias("citations"))
    return w.select(F.col("w.start").alias("start"), "provenance", "citations")


def upsert_batches(path: str, keys: list[str], buckets: int = 16):
    """A function for ``foreachBatch`` that keeps one row for each key, the newest batch winning, as a version ``path/v<number>`` of each batch.

    Of a key's rows in one batch the greatest of the rest of their columns stays. A batch that is run again rewrites its own version from the one before, so nothing counts twice; versions before
    that one are dropped. Versions are kept in ``buckets`` folders by the keys' hash, and folders no key of the batch falls into are taken over by their files, not rewritten.
    """

    def fs_of(spark):
        jvm = spark._jvm
        return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else batch.distinct()
        new = one.select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        fs, at = fs_of(spark)
        touched = {r[0] for r in new.select("bucket").distinct().collect()}  # ``buckets`` rows at most
        version, before = f"{path}/v{number}", f"{path}/v{number - 1}"
        out = new
        if number > 0:
            old = spark.read.option("basePath", before).parquet(before).filter(F.col("bucket").isin(sorted(touched)) if touched else F.lit(False))
            out = old.select(*new.columns).join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
        new.unpersist()
        if number > 0:
            for s in fs.listStatus(at(before)):
                name = s.getPath().getName()
                if name.startswith("bucket=") and int(name.split("=")[1]) not in touched:
                    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s.getPath(), fs, at(f"{version}/{name}"), False, True, spark._jsc.hadoopConfiguration())
        if number > 1:
            fs.delete(at(f"{path}/v{number - 2}"), True)

    return write
