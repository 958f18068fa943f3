"""UNION, EXCEPT and INTERSECT.  Columns go by position and take the left names; a key, which both sides or none must have, takes part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..model import col, has_key


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides of a set operation need as many columns")
    if has_key(left) != has_key(right):
        raise ValueError("both sides of a set operation need a key, or none")
    return right.toDF(*left.columns)


def union(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    out = left.union(_aligned(left, right))
    return out if all_rows else out.distinct()


def _filtered(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Left rows with (without) an equal right row, nulls equal; left duplicates stay."""
    other = _aligned(left, right).toDF(*(f"keyloom_{i}" for i in range(len(left.columns))))
    return left.join(other, reduce(lambda a, b: a & b, (col(c).eqNullSafe(other[f"keyloom_{i}"]) for i, c in enumerate(left.columns))), how)


def except_(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    """EXCEPT; ALL keeps every left row that has no equal on the right, so it isn't a difference of bags."""
    return _filtered(left, right, "left_anti") if all_rows else left.subtract(_aligned(left, right))


def intersect(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    """INTERSECT; ALL keeps every left row that has an equal on the right."""
    return _filtered(left, right, "left_semi") if all_rows else left.intersect(_aligned(left, right))
