"""Joins.  Catalyst chooses between broadcast, hash and sort-merge; nothing is broadcast by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import OPPOSITE, compare, truth
from ..model import KEY, col, has_key, value_columns


def demoted(df: DataFrame, prefix: str) -> DataFrame:
    """The key as the ordinary column ``prefix.key``: joins take it out of its role."""
    return df.withColumnRenamed(KEY, f"{prefix}.{KEY}") if has_key(df) else df


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", prefixes: tuple[str, str] = ("left", "right")) -> DataFrame:
    """INNER, LEFT, RIGHT or FULL join on any condition."""
    return demoted(left, prefixes[0]).join(demoted(right, prefixes[1]), on, how)


def cross_join(left: DataFrame, right: DataFrame, prefixes: tuple[str, str] = ("left", "right")) -> DataFrame:
    return demoted(left, prefixes[0]).crossJoin(demoted(right, prefixes[1]))


def _suffix(name: str, prefix: str) -> str:
    return name.removeprefix(f"{prefix}.")


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", prefixes: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Equality on columns named without their side's prefix; the preserved side's copy is kept."""
    a, b = (lambda c: f"{prefixes[0]}.{c}"), (lambda c: f"{prefixes[1]}.{c}")
    out = join(left, right, reduce(lambda x, y: x & y, (col(a(c)) == col(b(c)) for c in columns)), how, prefixes)
    return out.drop(*((a if how == "right" else b)(c) for c in columns))


def natural(left: DataFrame, right: DataFrame, how: str = "inner", prefixes: tuple[str, str] = ("left", "right")) -> DataFrame:
    """USING all columns that both sides have; an error if there is none."""
    theirs = {_suffix(c, prefixes[1]) for c in value_columns(right)}
    shared = [s for c in value_columns(left) if (s := _suffix(c, prefixes[0])) in theirs]
    if not shared:
        raise ValueError("a natural join needs a column that both sides have")
    return using(left, right, shared, how, prefixes)


def using_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by the row key, which stays the key."""
    return left.join(right, KEY, how)


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of fragments by key; of columns that both have, the left's value is taken where it isn't null."""
    both = [c for c in value_columns(left) if c in right.columns]
    other = right.withColumnsRenamed({c: f"keyloom_right.{c}" for c in both})
    out = left.join(other, KEY, "full")
    names = [KEY, *value_columns(left), *(c for c in value_columns(right) if c not in both)]
    return out.select(*(F.coalesce(col(c), col(f"keyloom_right.{c}")).alias(c) if c in both else col(c) for c in names))


def single(left: DataFrame, right: DataFrame, on: Column | None = None, value: str | None = None) -> DataFrame:
    """Left join with at most one match for each left row; more raise an error when the rows are read.

    Without a condition the right side is a scalar subquery.
    """
    name = value or value_columns(right)[0]
    if on is None:
        one = right.agg(F.count("*").alias("keyloom_n"), F.first(col(name)).alias(name))
        one = one.where(F.assert_true(F.col("keyloom_n") <= 1, F.lit("a scalar subquery has more than one row")).isNull()).select(col(name))
        return left.crossJoin(one)  # one row
    rows = left.withColumn("keyloom_id", F.monotonically_increasing_id())
    joined = rows.join(right, on, "left").groupBy("keyloom_id", *map(col, left.columns)).agg(F.count(col(name)).alias("keyloom_n"), F.first(col(name)).alias(name))
    return joined.where(F.assert_true(F.col("keyloom_n") <= 1, F.lit("a scalar subquery has more than one row")).isNull()).drop("keyloom_id", "keyloom_n")


def exists(left: DataFrame, right: DataFrame, on: Column | None = None, negated: bool = False) -> DataFrame:
    """[NOT] EXISTS.  Without a condition it asks whether the right side has any row."""
    if on is None:
        right, on = right.select(F.lit(1).alias("keyloom_one")).limit(1), F.lit(True)
    return left.join(right, on, "left_anti" if negated else "left_semi")


def in_subquery(left: DataFrame, value: Column, right: DataFrame, negated: bool = False) -> DataFrame:
    """[NOT] IN: a null on the right never empties the result; a null on the left is in nothing, and not kept by NOT IN."""
    other = right.select(col(value_columns(right)[0]).alias("keyloom_in"))
    out = left.join(other, value == F.col("keyloom_in"), "left_anti" if negated else "left_semi")
    return out.where(value.isNotNull()) if negated else out


def quantified(left: DataFrame, value: Column, op: str, right: DataFrame, all_of: bool = False) -> DataFrame:
    """value op ANY / ALL of the right side's first column, decided on its extremes instead of by comparing all rows.

    Nulls on the right compare with nothing.  ALL over no rows is true, ANY is false; a null value fails either way over some rows.
    """
    name = value_columns(right)[0]
    facts = right.agg(F.min(col(name)).alias("keyloom_lo"), F.max(col(name)).alias("keyloom_hi"), F.count(col(name)).alias("keyloom_n"))
    lo, hi, n = F.col("keyloom_lo"), F.col("keyloom_hi"), F.col("keyloom_n")
    if op in ("=", "!="):
        if (op == "=") != all_of:  # = ANY, != ALL: a semi and an anti join
            return in_subquery(left, value, right, negated=all_of) if not all_of else left.join(right.select(col(name).alias("keyloom_in")), value == F.col("keyloom_in"), "left_anti")
        same = (lo == hi) & (value == lo)
        test = truth(same) | (n == 0) if all_of else truth(~same) & (n > 0)
    else:
        bound = (hi if op in (">", ">=") else lo) if all_of else (lo if op in (">", ">=") else hi)
        test = compare(value, op, bound) | (n == 0) if all_of else compare(value, op, bound)
    return left.crossJoin(facts).where(test).drop("keyloom_lo", "keyloom_hi", "keyloom_n")  # one row


def mark(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], name: str = "mark", negated: bool = False) -> DataFrame:
    """Adds a boolean column: whether the row has a match (IN or EXISTS under OR).  Equal rows on the right count once."""
    keys = right.select(*(col(r).alias(f"keyloom_{i}") for i, (_, r) in enumerate(on))).distinct().withColumn("keyloom_hit", F.lit(True))
    condition = reduce(lambda x, y: x & y, (col(a) == F.col(f"keyloom_{i}") for i, (a, _) in enumerate(on)))
    found = truth(F.col("keyloom_hit"))
    return left.join(keys, condition, "left").select(*map(col, left.columns), (~found if negated else found).alias(name))


__all__ = ["OPPOSITE", "align", "cross_join", "demoted", "exists", "in_subquery", "join", "mark", "natural", "quantified", "single", "using", "using_key"]
