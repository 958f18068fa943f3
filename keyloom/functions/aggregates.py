"""Set functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions that take DISTINCT.
DISTINCT = {"min", "max", "sum", "avg", "count"}
NAMES = {"count", "sum", "avg", "min", "max", "first_value", "last_value"}


def aggregate(name: str, value: Column, key: Column | None = None, distinct: bool = False) -> Column:
    """count, sum, avg, min, max, first_value or last_value of non-null values; null over none (count 0).

    first_value and last_value need a key that orders the rows and are deterministic as far
    as the key is unique.
    """
    name = name.lower()
    if distinct and name not in DISTINCT:
        raise ValueError(f"{name} doesn't take DISTINCT")
    if name == "count":
        return F.count_distinct(value) if distinct else F.count(value)
    if name == "sum":
        return F.sum_distinct(value) if distinct else F.sum(value)
    if name == "avg":
        # Distinct values are few beside the rows; their mean is that of their sum.
        return F.sum_distinct(value).cast("double") / F.nullif(F.count_distinct(value), F.lit(0)) if distinct else F.avg(value)
    if name in ("min", "max"):
        return getattr(F, name)(value)
    if name in ("first_value", "last_value"):
        if key is None:
            raise ValueError(f"{name} needs a key")
        by = F.when(value.isNotNull(), key)
        return (F.min_by if name == "first_value" else F.max_by)(value, by)
    raise ValueError(f"no such set function: {name}")


def dev(value: Column) -> Column:
    """Population variance, E[x^2] - E[x]^2."""
    return F.var_pop(value)
