"""Keyed pseudo-random numbers: pure functions of a key, the same on any cluster and in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What split and sample keys are prefixed with.
SPLIT_SALT, SAMPLE_SALT = "quillsieve-split-v1", "quillsieve-sample-v1"


def hash_unit(key: Column, salt: str = SPLIT_SALT) -> Column:
    """A number in [0, 1): the first 13 hex digits of sha1('salt:key') over 16^13."""
    digest = F.sha1(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def hash_seed(key: Column) -> Column:
    """The first 8 hex digits of sha1(key) as a number."""
    return F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long")


def dev_or_test(key: Column, dev_fraction: float) -> Column:
    return F.when(hash_unit(key) < dev_fraction, F.lit("dev")).otherwise(F.lit("test"))


def sample_window(rows: DataFrame, key: str, by: list[str], first: int, last: int | None = None) -> DataFrame:
    """Rows first..last (from 1) of each group in hash order of key: nested samples, offsets, and their recovery from a superset."""
    order = Window.partitionBy(*by).orderBy(hash_unit(F.col(key), SAMPLE_SALT), key)
    ranked = rows.withColumn("_place", F.row_number().over(order))
    kept = ranked.where(F.col("_place") >= first) if last is None else ranked.where(F.col("_place").between(first, last))
    return kept.drop("_place")


def take_n(rows: DataFrame, n: int | None, key: str, by: list[str] | None = None, offset: int = 0) -> DataFrame:
    """The first n rows of each group by hash of key after an offset; every row if n is None."""
    if n is None and not offset:
        return rows
    if not by and not offset:
        return rows.orderBy(hash_unit(F.col(key), SAMPLE_SALT), key).limit(n)
    return sample_window(rows, key, by or [], offset + 1, None if n is None else offset + n)
