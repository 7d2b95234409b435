"""A file stream that keeps a chunk table current: every batch runs the manifest diff and publishes a version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The newest published version of a table folder, empty where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(int(n.removeprefix("v=")) for n in found if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS")))
    return spark.read.schema(schema).parquet(f"{table}/v={done[-1]}") if done else spark.createDataFrame([], schema)


def refresh_stream(files: DataFrame, table: str, checkpoint: str, to_chunks: Callable[[DataFrame], DataFrame], schema: str, once: bool = True):
    """Starts a stream of (rel_path, hash, text) rows. A batch replaces the chunks of files whose hash changed.

    A version is a folder of its own, complete when Spark has marked it; readers take the newest complete one, so a
    lost executor or a batch run again leaves no half table. schema: that of the chunks, with source_path and file_hash.
    """

    def publish(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, table, schema)
        known = old.groupBy("source_path").agg(F.max("file_hash").alias("old_hash"))
        newest = batch.groupBy("rel_path").agg(F.max_by(F.struct("hash", "text"), "hash").alias("f")).select("rel_path", "f.*")
        changed = newest.join(known, newest["rel_path"] == known["source_path"], "left").where(~F.col("hash").eqNullSafe(F.col("old_hash"))).select("rel_path", "hash", "text")
        fresh = to_chunks(changed)
        kept = old.join(changed.select(F.col("rel_path").alias("source_path")), "source_path", "left_anti")
        kept.select(*fresh.columns).unionByName(fresh).write.mode("overwrite").parquet(f"{table}/v={version}")

    writer = files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
