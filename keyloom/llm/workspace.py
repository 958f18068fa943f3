"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A fresh folder under ``spark.checkpoint.dir``; a local temporary one only where that is unset (tests)."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written once as Parquet and read again with the schema they had."""
        path = f"{self.path}/{name}"
        self.tables.append(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_zstd(self, df: DataFrame, name: str) -> DataFrame:
        """As :meth:`write`, for large binary columns."""
        path = f"{self.path}/{name}"
        self.tables.append(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_others(self, *kept: str) -> None:
        """Deletes all tables but those named."""
        self.drop(*(n for n in self.tables if n not in kept))
        self.tables = list(kept)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Frees the disk of finished shuffles: Spark deletes their files once the driver's JVM finds that nothing refers to them."""
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
