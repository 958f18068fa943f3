"""Unary operators over path-addressed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import compare, like, truth
from ..model import KEY, col, expand, has_key, matches, quoted, value_columns
from ..plans.cut import written


def project(df: DataFrame, patterns: list[str], tag_filter=None, keep_key: bool = True) -> DataFrame:
    """Columns that match the patterns, pattern by pattern, with the key in front if there is one."""
    names = list(dict.fromkeys(n for p in patterns for n in expand(df, p, tag_filter)))
    return df.select(*([KEY] if keep_key and has_key(df) else []), *map(col, names))


def select(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; null counts as false."""
    return df.where(condition)


def wildcard_compare(df: DataFrame, pattern: str, op: str, value, all_of: bool = False) -> Column:
    """``a.* > 5``: some matching column compares true (nulls skipped); ``&>``: all do, and none is null."""
    parts = [compare(col(n), op, F.lit(value)) for n in expand(df, pattern)]
    return reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), parts) if parts else F.lit(False)


def wildcard_like(df: DataFrame, pattern: str, regex: str, all_of: bool = False) -> Column:
    parts = [like(col(n).cast("string"), regex) for n in expand(df, pattern)]
    return reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), parts) if parts else F.lit(False)


def in_list(value: Column, values: list, negated: bool = False) -> Column:
    """IN with two truth values: a null is in no list, and NOT IN is true for it only where the caller keeps nulls."""
    found = truth(value.isin(values)) if values else F.lit(False)
    return value.isNotNull() & ~found if negated else found


def sort(df: DataFrame, by: list[tuple[Column, bool]]) -> DataFrame:
    """ORDER BY (expression, descending); nulls first ascending, last descending."""
    return df.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in by))


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(count)


def distinct(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Distinct rows; the key isn't part of a row, and nulls are equal."""
    return project(df, patterns or ["*"], keep_key=False).distinct()


def rename(df: DataFrame, pairs: dict[str, str], ignore: list[str] | None = None) -> DataFrame:
    """Renames columns; a pattern and a name with one ``*`` each carry what the star stood for."""
    new = {}
    for name in value_columns(df):
        if any(matches(p, name) for p in ignore or []):
            continue
        for old, alias in pairs.items():
            if name == old:
                new[name] = alias
                break
            if "*" in old and matches(old, name):
                head, _, tail = old.partition("*")
                star = name[len(head) : len(name) - len(tail)] if tail else name[len(head) :]
                new[name] = alias.replace("*", star, 1)
                break
    return df.withColumnsRenamed(new)


def as_key(df: DataFrame, column: str) -> DataFrame:
    """Makes a column the row key.  A key that comes twice raises an error when the rows are read."""
    rows = df.drop(KEY) if column != KEY else df
    keyed = rows.select(col(column).cast("long").alias(KEY), *(col(c) for c in rows.columns if c not in (column, KEY)))
    counts = keyed.groupBy(KEY).agg(F.count("*").alias("rows_of_key"))
    checked = counts.where(F.assert_true((F.col("rows_of_key") == 1) & F.col(KEY).isNotNull(), F.lit("a key is missing or comes more than once")).isNull())
    return keyed.join(checked.select(KEY), KEY, "left_semi")


def demote_key(df: DataFrame, name: str = KEY) -> DataFrame:
    """The key as an ordinary column."""
    return df.withColumnRenamed(KEY, name)


def reorder(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Columns in the patterns' order; key, window_start and window_end stay in front."""
    front = [c for c in (KEY, "window_start", "window_end") if c in df.columns]
    rest = list(dict.fromkeys(n for p in patterns for n in expand(df, p)))
    return df.select(*map(col, front), *(col(n) for n in rest if n not in front))


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(col(c).alias(c if c == KEY else f"{prefix}.{c}") for c in df.columns))


def add_sequence(df: DataFrame, order: list[Column], name: str = "sequence", start: int = 0, step: int = 1, per_range: int = 1_000_000) -> DataFrame:
    """Appends start, start + step, ... in the given order, without sorting all rows in one task.

    Rows are range-partitioned by the order; each partition is numbered for itself and
    moved by the number of rows before it, of which there is one for each partition.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("keyloom_part", F.spark_partition_id()).withColumn("keyloom_at", F.monotonically_increasing_id())
    # The id's low 33 bits count the rows of a sorted partition.
    placed = placed.withColumn("keyloom_at", F.col("keyloom_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # Spark samples for its ranges anew in each use, so the placed rows are written once.
    placed = written(placed)
    sizes = placed.groupBy("keyloom_part").agg(F.count("*").alias("keyloom_n"))
    before = sizes.select("keyloom_part", F.coalesce(F.sum("keyloom_n").over(Window.orderBy("keyloom_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("keyloom_before"))
    joined = placed.join(F.broadcast(before), "keyloom_part")
    return joined.select(*map(col, df.columns), ((F.col("keyloom_before") + F.col("keyloom_at")) * step + start).cast("long").alias(name))


def remove_null_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are null in every row: one aggregation is run for it."""
    names = value_columns(df)
    if not names:
        return df
    found = df.agg(*(F.count(col(n)).alias(str(i)) for i, n in enumerate(names))).first()
    return df.select(*([KEY] if has_key(df) else []), *(col(n) for i, n in enumerate(names) if found[i]))


def values_to_paths(df: DataFrame, prefix: str = "") -> list[str]:
    """The paths that a small result's cells spell: row by row, null and empty cells skipped.  Rows come to the driver."""
    out = []
    for row in df.select(*map(col, value_columns(df))).toLocalIterator():
        out += [f"{prefix}.{v}" if prefix else str(v) for v in row if v is not None and str(v) != ""]
    return list(dict.fromkeys(out))


def show_columns(df: DataFrame, patterns: list[str] | None = None, tag_filter=None, count: int | None = None, offset: int = 0) -> DataFrame:
    """(Path, Type) of the columns, in their order by name."""
    names = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "LONG", "float": "FLOAT", "double": "DOUBLE"}
    kinds = dict(df.dtypes)
    chosen = sorted({n for p in patterns or ["*"] for n in expand(df, p, tag_filter)})
    chosen = chosen[offset : None if count is None else offset + count]
    return df.sparkSession.createDataFrame([(n, names.get(kinds[n], "BINARY")) for n in chosen], "Path string, Type string")


def group_by(df: DataFrame, keys: list[Column], aggregates: list[Column], having: Column | None = None) -> DataFrame:
    """Groups by expressions, null being a group; the output has no key."""
    out = df.groupBy(*keys).agg(*aggregates)
    return out.where(having) if having is not None else out


def union_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """All columns of both, missing ones null."""
    return left.unionByName(right, allowMissingColumns=True)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "reduce", "quoted")]
