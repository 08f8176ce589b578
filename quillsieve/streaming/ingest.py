"""Incremental work: keyed resume in batches, and a file stream that appends each key once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(planned: DataFrame, done: DataFrame, keys: list[str], failed: DataFrame | None = None, failed_keys: list[str] | None = None) -> DataFrame:
    """Planned work without what is done, and without what failed unless it is asked for again."""
    left = planned.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if failed is None else left.join(failed.select(*(failed_keys or keys)).distinct(), failed_keys or keys, "left_anti")


def missing(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises unless every key of left is in right."""
    found = [r[0] for r in left.join(right, key, "left_anti").select(key).distinct().limit(5).collect()]
    if found:
        raise ValueError(f"no match for {key}: {found}")


def guard(spark: SparkSession, path: str, settings: dict) -> None:
    """Refuses to append under settings other than those recorded beside the table; records them at first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    text = json.dumps(settings, sort_keys=True)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.text(path).first()[0]
        if held != text:
            raise ValueError(f"settings differ from those of the table: {held} and {text}")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def seen_keys(spark: SparkSession, index: str, buckets: list[int]) -> DataFrame:
    """The keys of an index that fall into some buckets; no other file of it is read."""
    return spark.read.parquet(index).where(F.col("_bucket").isin(buckets)).drop("_bucket")


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], buckets: int = 64) -> StreamingQuery:
    """Streams JSON files of a folder into a parquet table, each key once, however often it comes or the stream restarts.

    What is in the table is looked up in an index of its keys beside the checkpoint, in buckets of
    which a batch reads those of its own keys. The table itself is read only where a batch is written
    again after a failure: a marker that is made before it tells.
    """
    index = f"{checkpoint}-keys"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path
        fs = path(index).getFileSystem(session._jsc.hadoopConfiguration())
        rows = batch.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        fresh = rows
        if fs.exists(path(f"{index}/data")) and touched:
            fresh = fresh.join(seen_keys(session, f"{index}/data", touched), keys, "left_anti")
        marker = path(f"{index}/started-{number}")
        if not fs.createNewFile(marker) and fs.exists(path(sink)):
            fresh = fresh.join(session.read.schema(batch.schema).parquet(sink).select(*keys), keys, "left_anti")
        fresh = fresh.persist()
        fresh.drop("_bucket").write.mode("append").parquet(sink)
        fresh.select(*keys, "_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{index}/data")
        fs.delete(path(f"{index}/started-{number - 1}"), False)
        fresh.unpersist()
        rows.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
