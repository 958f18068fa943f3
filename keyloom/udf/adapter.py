"""Python functions of the form ``transform(self, data, args, kvargs)`` on Arrow batches.

``data`` is [names, types, row, row, ...]; the result has the same three parts.  Three
kinds: UDTF (row to row, several columns), UDAF (rows to one), UDSF (rows to rows).
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import KEY, col, value_columns
from . import rows as _rows
from .rows import Data, Group

# Sent with each function, so that workers need not have this package.
cloudpickle.register_pickle_by_value(_rows)

# Type names that functions see and give back.
_TYPES = {"BOOLEAN": "boolean", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "BINARY": "string"}
_NAMES = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "LONG", "float": "FLOAT", "double": "DOUBLE", "string": "BINARY"}


def load_class(file: str, name: str) -> type:
    """``module.Class`` or ``Class`` from a Python file."""
    spec = importlib.util.spec_from_file_location(name.rpartition(".")[0] or "keyloom_udf", file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name.rpartition(".")[2])


def udtf(function: Callable, columns: list[tuple[Column, str]], args: list, kvargs: dict, outputs: list[tuple[str, str]], key: Column | None = None) -> tuple[list[tuple[Column, str]], Column]:
    """Applies a row function to each row's key and columns; ``outputs`` are (name, type) of what it returns.

    Returns the outputs and the rows' key: what the function gives as its first column
    ``key``, or else the key it got (0 where rows have none).
    """
    fields = [T.StructField("k", T.LongType()), *(T.StructField(f"c{i}", T._parse_datatype_string(_TYPES.get(t, t))) for i, (_, t) in enumerate(outputs))]
    names = [n for _, n in columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        made = function().transform if isinstance(function, type) else function
        rows = []
        for row in frame.itertuples(index=False):
            row = [None if v is pd.NA or v != v else v for v in row]
            out = made([[KEY, *names], ["LONG"] * (len(names) + 1), row], args, kvargs)
            last = list(out[-1]) if out and len(out) > 2 else [None] * len(outputs)
            keyed = bool(out) and len(last) > len(outputs) and str(out[0][0]).lower() == KEY
            rows.append([last[0] if keyed else row[0], *last[-len(outputs) :]])
        return pd.DataFrame(rows, columns=[f.name for f in fields])

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    made = F.pandas_udf(run, T.StructType(fields))(F.struct((F.lit(0) if key is None else key).cast("long").alias("key"), *(c.alias(f"a{i}") for i, (c, _) in enumerate(columns))))
    return [(made[f"c{i}"], n) for i, (n, _) in enumerate(outputs)], made["k"]


class SetCall:
    """A call of a set function on columns of each group."""

    def __init__(self, function: Callable, columns: list[tuple[Column, str]], key: Column | None, args: list, kvargs: dict):
        self.function, self.args, self.kvargs = function, args, kvargs
        self.names = [n for _, n in columns]
        self.columns = [(F.lit(0) if key is None else key).cast("long"), *(c for c, _ in columns)]

    def head(self) -> list[list]:
        return [[KEY, *self.names], ["LONG"] + ["DOUBLE"] * len(self.names)]

    def plain(self) -> Callable:
        """The function over its data alone, without columns, which can't be sent."""
        function, args, kvargs = self.function, self.args, self.kvargs
        return lambda data: (function().transform if isinstance(function, type) else function)(data, args, kvargs)


class SetValue:
    """What a :class:`SetCall` gives at a place of its result; stands for an aggregate in :func:`aggregated`."""

    def __init__(self, call: SetCall, pick: int, kind: str, name: str = ""):
        self.call, self.pick, self.kind, self.name = call, pick, kind, name

    def alias(self, name: str) -> SetValue:
        return SetValue(self.call, self.pick, self.kind, name)


def udaf(function: Callable, kind: str = "double") -> Callable:
    """A set-to-value function as an aggregate, for :func:`aggregated`, over (columns, key, args, kvargs).

    Gives its value and, if its result has a first column ``key``, the key; else None.
    """

    def aggregate(columns: list[tuple[Column, str]], key: Column | None, args: list, kvargs: dict) -> tuple[SetValue, SetValue | None]:
        call = SetCall(function, columns, key, args, kvargs)
        try:
            # One made-up row shows whether the result has a key.
            keyed = key is not None and str(call.plain()([*call.head(), [0] * (len(columns) + 1)])[0][0]).lower() == KEY
        except Exception:  # a function that fails on that row has no key as far as is known
            keyed = False
        return SetValue(call, -1, _TYPES.get(kind, kind)), SetValue(call, 0, "bigint") if keyed else None

    return aggregate


def aggregated(df: DataFrame, keys: list[Column], aggregates: list[Column | SetValue]) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)``, where all aggregates may be those of :func:`udaf`.

    A group's rows come together in one task, but never into its memory: they stream past or,
    where there are many, wait in a temporary file, and the function gets a sequence that
    makes rows as they are asked for (:class:`.rows.Data`).  What the function keeps of them is its own.
    """
    values = [a for a in aggregates if isinstance(a, SetValue)]
    if not values:
        return df.groupBy(*keys).agg(*aggregates)
    if len(values) < len(aggregates):
        raise ValueError("set functions in Python don't stand beside others in one select")
    calls = list({id(v.call): v.call for v in values}.values())
    per_call, columns = [], list(keys)
    for call in calls:
        per_call.append(list(range(len(columns), len(columns) + len(call.columns))))
        columns += call.columns
    plain = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    fields = [T.StructField(f"c{i}", plain.schema[i].dataType) for i in range(len(keys))] + [T.StructField(f"v{i}", T._parse_datatype_string(v.kind)) for i, v in enumerate(values)]
    types = to_arrow_schema(T.StructType(fields))
    places = [([c is v.call for c in calls].index(True), v.pick) for v in values]
    own = [call.head() for call in calls]
    functions = [c.plain() for c in calls]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        group = Group(chain([first], batches))
        try:
            results = []
            for head, at, function in zip(own, per_call, functions, strict=True):
                results.append(function(Data(head, group, at)))
            out = [results[i] for i, _ in places]
            found = [r[-1][pick] if r and len(r) > 2 else None for r, (_, pick) in zip(out, places, strict=True)]
        finally:
            group.close()
        # As Spark makes them of what a function over pandas gives.
        made = [pd.Series([v]) for v in found]
        arrays = [pa.Array.from_pandas(v, mask=v.isnull(), type=t.type) for v, t in zip(made, list(types)[n_keys:], strict=True)]
        yield pa.RecordBatch.from_arrays([first.column(i).slice(0, 1) for i in range(n_keys)] + arrays, names=types.names)

    return plain.groupBy(*(f"c{i}" for i in range(n_keys))).applyInArrow(run, T.StructType(fields)).toDF(*df.select(*keys).columns, *(v.name for v in values))


def udsf(function: Callable, schema: str) -> Callable:
    """A table function: all rows, in key order, through one call.  The table must fit one task's memory."""

    def apply(df: DataFrame, args: list, kvargs: dict) -> DataFrame:
        names = value_columns(df)
        kinds = [_NAMES.get(t, "BINARY") for n, t in df.dtypes if n != KEY]
        keyed = KEY in df.columns

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            made = function().transform if isinstance(function, type) else function
            frame = frame.sort_values(KEY) if keyed else frame
            rows = frame.where(frame.notna(), None).values.tolist()
            data = [([KEY] if keyed else []) + names, (["LONG"] if keyed else []) + kinds, *rows]
            out = made(data, args, kvargs)
            return pd.DataFrame(out[2:], columns=out[0])

        order = [*([KEY] if keyed else []), *names]
        # Plain names on the way to pandas, as dots would be read as paths of structs.
        plain = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(order)))
        return plain.groupBy().applyInPandas(lambda frame: run(frame.set_axis(order, axis=1)), schema)

    return apply


def transform(function: Callable, df: DataFrame, schema: str, batch: bool = True, rows: int = 50) -> DataFrame:
    """A TRANSFORM stage over pandas frames: the whole table at once, or streamed in chunks of ``rows``."""
    if batch:
        return df.groupBy().applyInPandas(lambda frame: function(frame), schema)

    def chunks(frames):
        for frame in frames:
            for lo in range(0, len(frame), rows):
                yield function(frame.iloc[lo : lo + rows])

    return df.mapInPandas(chunks, schema)


def reverse_rows(data: list, args: list, kvargs: dict) -> list:
    return [*data[:2], *data[2:][::-1]]


def transpose(data: list, args: list, kvargs: dict) -> list:
    start = 1 if data[0] and data[0][0] == KEY else 0
    rows = [r[start:] for r in data[2:]]
    return [[str(i) for i in range(len(rows))], ["DOUBLE"] * len(rows), *map(list, zip(*rows, strict=True))]


__all__ = ["aggregated", "col", "load_class", "reverse_rows", "transform", "transpose", "udaf", "udsf", "udtf"]
