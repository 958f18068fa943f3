"""Written tables that fix rows which a plan would otherwise compute twice, and perhaps differently."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, or a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/keyloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from Parquet, their order and partition numbers as computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
