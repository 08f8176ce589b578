"""What the training-data operators share: tables, shared scratch tables, the word pattern."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but a space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast, of at most a few dozen bytes each; beyond it operators join by shuffling.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="quillsieve-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillsieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillsieve_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a result of stored() that nothing reads any more."""
    path = getattr(df, "_quillsieve_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which should be stored, has few enough rows to be broadcast."""
    return df.limit(rows + 1).count() <= rows if rows < 1000 else df.count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else with one against: Spark goes by the bytes of files, which are far fewer than those in memory."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def words(text: Column) -> Column:
    """The words of a text, in order; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\u000b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    """How many words a text has; null counts as empty."""
    return F.size(words(text)).cast("long")


def row_hash() -> Column:
    """What tells rows with doc_id and text apart; rows equal in both count as one."""
    return F.xxhash64(F.coalesce(F.xxhash64("doc_id", F.lit(1)), F.lit(0)), "text")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use, whatever columns it brings along."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
