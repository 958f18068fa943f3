"""Downsampling over windows of the integer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, col, has_key
from ..udf.adapter import SetValue, aggregated


def downsample(df: DataFrame, size: int, aggregates: list[Column | SetValue], slide: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Aggregates over windows of ``size`` keys every ``slide`` keys within [start, end).

    Without an interval windows start at the first key and the last one begins so that it
    still ends by the last key's slide.  Output: key and window_start (the window's first
    key), window_end (its last), the aggregates; windows without rows are left out.
    """
    slide = size if slide is None else slide
    if not has_key(df):
        raise ValueError("downsampling needs a key")
    if size < 1 or slide < 1:
        raise ValueError("size and slide must be positive")
    if start is not None:
        df = df.where((F.col(KEY) >= start) & (F.col(KEY) < end))
        rows = df.withColumn("keyloom_bias", F.lit(start).cast("long")).withColumn("keyloom_end", F.lit(end).cast("long"))
    else:
        span = df.agg(F.min(KEY).alias("keyloom_bias"), F.max(KEY).alias("keyloom_end"))
        rows = df.crossJoin(F.broadcast(span))  # one row
    bias, key = F.col("keyloom_bias"), F.col(KEY)
    if slide == size:
        rows = rows.withColumn("window_start", key - F.pmod(key - bias, F.lit(size)))
    else:
        # The windows i with bias + i*slide <= key < bias + i*slide + size: each key makes ceil(size/slide) rows at most.
        last = F.floor((key - bias) / slide)
        first = F.greatest(F.lit(0), F.floor((key - bias - size) / slide) + 1)
        most = F.greatest(F.lit(0), F.ceil((F.col("keyloom_end") - bias - size + 1) / slide))
        top = F.least(last, most)
        rows = rows.where(first <= top).withColumn("keyloom_i", F.explode(F.sequence(first.cast("long"), top.cast("long")))).withColumn("window_start", bias + F.col("keyloom_i") * slide)
    out = aggregated(rows, [F.col("window_start")], aggregates)
    return out.select(F.col("window_start").alias(KEY), "window_start", (F.col("window_start") + (size - 1)).alias("window_end"), *(col(c) for c in out.columns if c != "window_start"))
