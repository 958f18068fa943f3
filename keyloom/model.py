"""Names, patterns, tags and keys of path-addressed tables.

A table is a flat DataFrame.  A column's literal name is its full dotted path; a tagged
column is named ``path{k=v,...}`` and carries path and tags in its field's metadata.  The
row key, where a table has one, is the bigint column ``key``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "key"
KEY_MIN, KEY_MAX = -(2**63) + 1, 2**63 - 1


def quoted(name: str) -> str:
    """A literal column name for Spark, dots included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def matches(pattern: str, path: str) -> bool:
    """Whether a path matches; ``*`` stands for any run of characters, dots included."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path, re.DOTALL) is not None


def tagged(path: str, tags: dict[str, str] | None = None) -> str:
    """A column's full name."""
    return path + ("{" + ",".join(f"{k}={v}" for k, v in sorted(tags.items())) + "}" if tags else "")


def split_tags(name: str) -> tuple[str, dict[str, str]]:
    """Path and tags of a full name."""
    found = re.fullmatch(r"(.*?)\{(.*)\}", name, re.DOTALL)
    if not found:
        return name, {}
    return found[1], dict(item.split("=", 1) for item in found[2].split(",") if item)


def with_tags(df: DataFrame, name: str, tags: dict[str, str]) -> DataFrame:
    """Gives a column tags, which become part of its name."""
    full = tagged(name, tags)
    return df.withColumnRenamed(name, full).withMetadata(full, {"path": name, "tags": tags})


def expand(df: DataFrame, pattern: str, tag_filter=None) -> list[str]:
    """Columns of ``df`` (not the key) whose path matches, in their order; ``tag_filter`` takes a tag map."""
    out = []
    for name in df.columns:
        if name == KEY:
            continue
        path, tags = split_tags(name)
        if (name == pattern or matches(pattern, path)) and (tag_filter is None or tag_filter(tags)):
            out.append(name)
    return out


def has_key(df: DataFrame) -> bool:
    return KEY in df.columns


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != KEY]


# Tag filters: predicates over a column's tag map, used when columns are chosen.


def tag_equals(key: str, value: str):
    return lambda tags: key in tags and (value == "*" or matches(value, tags[key]))


def tag_and(*parts):
    return lambda tags: all(p(tags) for p in parts)


def tag_or(*parts):
    return lambda tags: any(p(tags) for p in parts)


def tag_precise(wanted: list[dict[str, str]]):
    """One of the given tag sets, and no tag more."""
    return lambda tags: tags in wanted


def without_tags(tags: dict[str, str]) -> bool:
    return not tags
