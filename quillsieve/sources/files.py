"""Readers and writers of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators.documents import DOCUMENT


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Question-and-context documents of JSON lines, under the fixed schema."""
    return spark.read.schema(DOCUMENT).json(path)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    docs.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines whose last line may be torn; a bad line anywhere else is an error.

    A missing path gives no rows. Each file is read as one partition in order, so its last line is known.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    # monotonically_increasing_id grows with the place within a file, whichever partitions hold it.
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    parsed = lines.select("file", "at", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = parsed.where("r._bad IS NOT NULL").groupBy("file").agg(F.min("at").alias("bad"))
    last = parsed.groupBy("file").agg(F.max("at").alias("last"))
    if bad.join(last, "file").where("bad < last").limit(1).count():
        raise ValueError(f"{path}: a line that isn't the last of its file is not valid JSON")
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad")


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of one-record JSON files, without its summaries and settings."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where(~F.element_at(F.split(F.input_file_name(), "/"), -1).rlike(r"(summary|config)\.json$"))


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Numbered shard files, with the number of each row's shard."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.withColumn("shard", F.regexp_extract(F.input_file_name(), r"shard(\d+)", 1).cast("int"))


def write_partitioned(rows: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """The named fields only, with a header."""
    rows.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
