"""Set functions that return rows, bucketed series aggregators, and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, dev
from ..model import KEY, col, value_columns
from .curve import key_cuts

#: Rows for each range of keys that a single series is cut into.
RANGE = 1_000_000


def first_last(df: DataFrame, which: str = "last", columns: list[str] | None = None) -> DataFrame:
    """first/last: (key, path, value as text), a row for each column with its first or last non-null value.

    One aggregation over all columns side by side; the rows are made from its single row.
    """
    names = columns or value_columns(df)
    pick = F.min_by if which == "first" else F.max_by
    found = df.agg(*(pick(F.struct(F.col(KEY).alias("k"), col(n).cast("string").alias("v")), F.when(col(n).isNotNull(), F.col(KEY))).alias(f"c{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.col(f"c{i}.k").alias(KEY), F.lit(n).alias("path"), F.col(f"c{i}.v").alias("value")) for i, n in enumerate(names)))
    return found.select(F.explode(rows).alias("r")).select("r.*").where(F.col(KEY).isNotNull())


def bucketed(df: DataFrame, value: str, function: str, size: int, by: list[str] | None = None, p: float | None = None, start: int = 0) -> DataFrame:
    """max, min, sum, count, avg, first, last, dev or percentile of a column in buckets of ``size`` keys; the key is the bucket's first."""
    v = col(value)
    bucket = (F.col(KEY) - F.pmod(F.col(KEY) - start, F.lit(size))).alias(KEY)
    if function == "dev":
        agg = dev(v)
    elif function == "percentile":
        return _percentiles(df.where(v.isNotNull()).groupBy(bucket, *map(col, by or []), v.alias(value)).agg(F.count("*").alias("keyloom_n")), value, by or [], p)
    elif function in ("first", "last"):
        agg = aggregate(f"{function}_value", v, F.col(KEY))
    else:
        agg = aggregate(function, v)
    return df.where(v.isNotNull()).groupBy(bucket, *map(col, by or [])).agg(agg.alias(value))


def _percentiles(counted: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """sorted[floor(p * (n - 1))] of each bucket's values, exact, from the values' counts; no bucket is held in memory."""
    bucket = Window.partitionBy(KEY, *map(col, by))
    upto = F.sum("keyloom_n").over(bucket.orderBy(col(value)).rowsBetween(Window.unboundedPreceding, 0))
    at = F.floor(F.lit(p) * (F.sum("keyloom_n").over(bucket) - 1))
    placed = counted.withColumn("keyloom_upto", upto).withColumn("keyloom_at", at)
    return placed.where("keyloom_at < keyloom_upto AND keyloom_at >= keyloom_upto - keyloom_n").select(KEY, *map(col, by), col(value))


def _with_previous(df: DataFrame, value: str, by: list[str] | None, per_range: int) -> DataFrame:
    """The rows that have a value, and in ``keyloom_before`` the key k and value v of the row before in their series.

    A table that is one series is cut into ranges of keys, so that no task sorts all of it;
    the row before a range's first is the last one of the range before, one for each range.
    """
    rows = df.where(col(value).isNotNull())
    own = F.struct(F.col(KEY).alias("k"), col(value).alias("v"))
    if by:
        return rows.withColumn("keyloom_before", F.lag(own).over(Window.partitionBy(*map(col, by)).orderBy(KEY)))
    cuts = key_cuts(rows, per_range)
    ranged = rows.withColumn("keyloom_range", F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col(KEY))) if cuts else F.lit(0))
    ends = ranged.groupBy("keyloom_range").agg(F.max_by(own, KEY).alias("keyloom_last"))
    # As many rows as ranges, which the cuts bound.
    ends = ends.select("keyloom_range", F.lag("keyloom_last").over(Window.orderBy("keyloom_range")).alias("keyloom_last"))
    within = F.lag(own).over(Window.partitionBy("keyloom_range").orderBy(KEY))
    joined = ranged.join(F.broadcast(ends), "keyloom_range").withColumn("keyloom_before", F.coalesce(within, F.col("keyloom_last")))
    return joined.drop("keyloom_range", "keyloom_last")


def _changed(df: DataFrame, value: str, by: list[str] | None, per_range: int, change) -> DataFrame:
    """The value becomes ``change`` of itself, of the previous value and of the distance in keys; rows without one go."""
    rows = _with_previous(df, value, by, per_range)
    found = change(col(value), F.col("keyloom_before.v"), F.nullif(F.col(KEY) - F.col("keyloom_before.k"), F.lit(0)))
    return rows.withColumn(value, found).drop("keyloom_before").where(col(value).isNotNull())


def diff(df: DataFrame, value: str, by: list[str] | None = None, per_range: int = RANGE) -> DataFrame:
    """x - previous x, of each series; a series' first row has none."""
    return _changed(df, value, by, per_range, lambda x, before, _: x - before)


def rate(df: DataFrame, value: str, unit: int, by: list[str] | None = None, per_range: int = RANGE) -> DataFrame:
    """(x - previous x) * unit / (key - previous key)."""
    return _changed(df, value, by, per_range, lambda x, before, step: (x - before) * F.lit(float(unit)) / step)


def sampler(df: DataFrame, value: str, unit: int, by: list[str] | None = None, per_range: int = RANGE) -> DataFrame:
    """x * unit / (key - previous key)."""
    return _changed(df, value, by, per_range, lambda x, _, step: x * F.lit(float(unit)) / step)


def div(df: DataFrame, value: str, divisor: float) -> DataFrame:
    return df.withColumn(value, col(value) / F.lit(float(divisor)))


def filter_values(df: DataFrame, value: str, op: str, than: float) -> DataFrame:
    """gt, gte, eq, ne, lt, lte: keeps the values that compare true."""
    from ..functions.scalar import compare

    return df.where(compare(col(value), {"gt": ">", "gte": ">=", "eq": "=", "ne": "!=", "lt": "<", "lte": "<="}[op], F.lit(than)))


def query_range(df: DataFrame, columns: list[str], start: int, end: int) -> DataFrame:
    """Rows with start <= key < end in which one of the columns has a value."""
    some = F.coalesce(*(col(c).cast("string") for c in columns)).isNotNull()
    return df.where((F.col(KEY) >= start) & (F.col(KEY) < end) & some).select(KEY, *map(col, columns))


def aggregate_query(df: DataFrame, columns: list[str], function: str, start: int, end: int) -> DataFrame:
    chosen = query_range(df, columns, start, end)
    return chosen.agg(*(aggregate(function, col(c), F.col(KEY)).alias(f"{function}({c})") for c in columns))


