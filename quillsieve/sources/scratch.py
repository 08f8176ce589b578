"""New folders for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, stem: str) -> str:
    """A new name in the folder that driver and executors share; a temporary folder only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillsieve-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{stem}-{uuid.uuid4().hex}"
