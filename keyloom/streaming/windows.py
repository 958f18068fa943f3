"""Downsampling of streams: event-time windows with a watermark, and ingestion into a point store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import PointStore


def windowed(stream: DataFrame, ts: str, size: str, aggregates: list[Column], slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Aggregates over event-time windows; rows later than ``late`` behind the newest are dropped."""
    w = F.window(ts, size, slide or size)
    out = stream.withWatermark(ts, late).groupBy(w, *(by or [])).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def run_to_table(df: DataFrame, path: str) -> DataFrame:
    """Runs a streaming aggregation over what there is; its result table is in files, those of each batch in place of the last.  No input, no rows."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/rows")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")
    query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def ingest(stream: DataFrame, store: PointStore, checkpoint: str):
    """Inserts every micro-batch of (key, columns...) into a point store."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.insert(df) if not df.isEmpty() else None).trigger(availableNow=True).start()


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages ``{"path": ..., "timestamp": ..., "value": ...}`` as (key, path, value)."""
    m = F.from_json(F.col(column).cast("string"), "path string, timestamp long, value double")
    return raw.select(m.alias("m")).select(F.col("m.timestamp").alias("key"), "m.path", "m.value").where("key IS NOT NULL")


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
