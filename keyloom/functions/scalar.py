"""Scalar expressions as Columns: arithmetic, comparisons with two truth values, regex LIKE, dates."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
OPPOSITE = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
MIRRORED = {"=": "=", "!=": "!=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def divide(a: Column, b: Column) -> Column:
    """Floating division; x/0 is +-Infinity, 0/0 is NaN; null in, null out."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign and the operands' type; by zero it is null."""
    return F.when(b != 0, a % F.nullif(b, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or either is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def float_to_double(a: Column) -> Column:
    """A float's decimal text as a double: 1.1f becomes 1.1."""
    return a.cast("string").cast("double")


def truth(condition: Column) -> Column:
    """Two-valued logic: a comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def compare(a: Column, op: str, b: Column) -> Column:
    """Two-valued; for conditions of filters and joins, where null fails anyway, :data:`COMPARE` leaves the optimizer its keys and pushed filters."""
    return truth(COMPARE[op](a, b))


def matches_like(text: Column, pattern: str) -> Column:
    """Full match of a regular expression; null for a null text."""
    return text.rlike(r"\A(?:" + pattern + r")\z")


def like(text: Column, pattern: str) -> Column:
    """Full match of a regular expression; false for a null text."""
    return truth(matches_like(text, pattern))


def substring(text: Column, start: int, length: int) -> Column:
    """``length`` characters from ``start``, counted from 1."""
    return F.substring(text, start, length)


def extract(millis: Column, part: str) -> Column:
    """year, month, day, hour, minute or second of epoch milliseconds, in UTC, as an integer."""
    part = part.lower()
    if part not in ("year", "month", "day", "hour", "minute", "second"):
        raise ValueError(f"no such part of a date: {part}")
    return F.date_part(F.lit(part), F.timestamp_millis(millis.cast("long"))).cast("int")


def case_when(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise) if otherwise is not None else out


# Nanoseconds of the units that intervals and window sizes are written in.
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "mo": 30 * 86400 * 10**9, "y": 365 * 86400 * 10**9}


def duration(text: str | int) -> int:
    """Nanoseconds of ``5s`` and the like, in sums such as ``1h30m``; a plain integer stays what it is."""
    if isinstance(text, int) or re.fullmatch(r"-?\d+", text):
        return int(text)
    parts = re.findall(r"(\d+)(mo|ms|us|ns|[ywdhms])", text.lower())
    if "".join(a + b for a, b in parts) != text.lower():
        raise ValueError(f"not a duration: {text}")
    return sum(int(a) * UNITS[b] for a, b in parts)


def date_nanos(text: str) -> int:
    """Nanoseconds since the epoch, UTC, of a date-time literal with ``-``, ``/`` or ``.`` as separators."""
    whole, _, fraction = re.sub(r"[/.](?=\d{1,2}[/. T]|\d{1,2}$)", "-", text.strip(), count=2).replace("T", " ").partition(".")
    fmt = "%Y-%m-%d %H:%M:%S" if " " in whole else "%Y-%m-%d"
    seconds = int(datetime.strptime(whole, fmt).replace(tzinfo=timezone.utc).timestamp())
    return seconds * 10**9 + int((fraction + "0" * 9)[:9] if fraction else 0)


def now() -> int:
    """Wall-clock nanoseconds."""
    return time.time_ns()


def timestamp_key(ts: Column, unit: str = "ms") -> Column:
    """A timestamp without zone as an epoch key, read as UTC."""
    micros = F.unix_micros(ts.cast("timestamp"))
    per = {"us": 1, "ms": 1000, "s": 1_000_000}[unit]
    return F.floor(micros / per).cast("long") if per > 1 else micros


# Functions that ship with the engine for single rows.
NATIVE = {"cos": F.cos, "arccos": F.acos, "acos": F.acos, "pow": F.pow, "multiply": lambda a, b: a * b}
