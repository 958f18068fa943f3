"""A session: mounted sources, the point store, functions, jobs, and SQL over all of them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import Jobs, read_job
from .model import KEY, KEY_MAX, KEY_MIN, col, expand, has_key, tagged, value_columns
from .operators import joins as J
from .operators import relational as R
from .operators import series as X
from .operators.curve import curve_match
from .operators.windows import downsample
from .plans.compiler import Compiler, Scope, SqlError, tag_filter
from .plans.parser import Node, parse
from .sources import files
from .sources.store import PointStore
from .udf import adapter

# SQL types by the Python type of a column's first value.
_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


class Session:
    def __init__(self, spark: SparkSession, store_path: str | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.sources: dict[str, DataFrame] = {}
        self.functions: dict[str, tuple[str, Callable]] = {}
        self.transforms: dict[str, tuple[Callable, str]] = {}
        self.store = PointStore(spark, store_path) if store_path else None
        self.jobs = Jobs(self)
        self.id = uuid.uuid4().int >> 66
        self.users: dict[str, dict] = {"root": {"password": None, "rights": ["READ", "WRITE", "ADMIN", "CLUSTER"]}}
        self.keep_null_columns = True

    # The catalogue.

    def mount(self, prefix: str, df: DataFrame, key: str | None = None) -> None:
        """Makes a DataFrame's columns readable as ``prefix.column``."""
        self.sources[prefix] = files.mounted(df, prefix, key)

    def unmount(self, prefix: str) -> None:
        del self.sources[prefix]

    def _all(self, wanted: Callable[[str], bool]) -> list[DataFrame]:
        out = []
        for df in self.sources.values():
            names = [c for c in value_columns(df) if wanted(c)]
            if names:
                out.append(df.select(*([KEY] if has_key(df) else []), *map(col, names)))
        if self.store:
            df = self.store.read(wanted)
            if value_columns(df):
                out.append(df)
        return out

    def table(self, path: str) -> DataFrame:
        """All columns below a path, those of several sources aligned by key."""
        prefix = path.rstrip("*").rstrip(".")
        parts = self._all(lambda n: prefix == "" or n.startswith(prefix + ".") or n == prefix or ("*" in prefix and bool(__import__("re").match(".*".join(map(__import__("re").escape, prefix.split("*"))) + r"\.", n))))
        if not parts:
            raise SqlError(f"no columns below {path}")
        if len(parts) == 1:
            return parts[0]
        if not all(map(has_key, parts)):
            raise SqlError(f"sources below {path} can't be aligned without keys")
        return reduce(J.align, parts)

    def columns(self, paths: list[str], tags=None, count: int | None = None, offset: int = 0) -> DataFrame:
        parts = self._all(lambda _: True)
        kinds = {n: t for df in parts for n, t in df.dtypes if n != KEY and n in {x for p in paths for x in expand(df, p, tags)}}
        names = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "LONG", "float": "FLOAT", "double": "DOUBLE"}
        rows = sorted((n, names.get(t, "BINARY")) for n, t in kinds.items())[offset : None if count is None else offset + count]
        return self._rows(rows, "Path string, Type string")

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # Functions.

    def register_udtf(self, name: str, function: Callable, outputs: list[tuple[str, str]]) -> None:
        self.functions[name] = ("UDTF", lambda columns, args, kvargs, key: adapter.udtf(function, columns, args, kvargs, [(f"{name}({', '.join(n for _, n in columns)})" if len(outputs) == 1 else o, t) for o, t in outputs], key))

    def register_udaf(self, name: str, function: Callable, kind: str = "double") -> None:
        self.functions[name] = ("UDAF", adapter.udaf(function, kind))

    def register_udsf(self, name: str, function: Callable, schema: str) -> None:
        self.functions[name] = ("UDSF", adapter.udsf(function, schema))

    def register_transform(self, name: str, function: Callable, schema) -> None:
        self.transforms[name] = (function, schema)

    # Statements.

    def sql(self, text: str) -> DataFrame:
        """Runs a statement.  Queries come back lazily; other statements run at once and return what they report."""
        q = parse(text)
        run = getattr(self, f"_{q.kind}", None)
        if run is not None:
            return run(q)
        return Compiler(self).query(q)

    def _done(self) -> DataFrame:
        return self._rows([("ok",)], "Result string")

    def _explain(self, q: Node) -> DataFrame:
        df = Compiler(self).query(q.query)
        plan = df._jdf.queryExecution().optimizedPlan().toString() if q.mode == "logical" else df._jdf.queryExecution().executedPlan().toString()
        return self._rows([(line,) for line in plan.splitlines()], "Plan string")

    def _need_store(self) -> PointStore:
        if self.store is None:
            raise SqlError("this session has no point store")
        return self.store

    def insert(self, rows: list[dict]) -> None:
        """Rows with ``key`` and full paths; missing and null cells are left alone."""
        names = list(dict.fromkeys(k for r in rows for k in r if k != KEY))
        kinds = {n: next((_KINDS[type(r[n])] for r in rows if r.get(n) is not None), "string") for n in names}
        cast = {"double": float}
        data = [(int(r[KEY]), *(None if r.get(n) is None else cast.get(kinds[n], lambda v: v)(r[n]) for n in names)) for r in rows]
        schema = ", ".join([f"{KEY} long", *(f"`{n}` {kinds[n]}" for n in names)])
        self._need_store().insert(self._rows(data, schema))

    def _insert(self, q: Node) -> DataFrame:
        names = [tagged(f"{q.prefix}.{c}", t) for c, t in q.columns]
        self.insert([{KEY: r[0], **dict(zip(names, r[1:], strict=True))} for r in q.rows])
        return self._done()

    def _insert_select(self, q: Node) -> DataFrame:
        df = Compiler(self).query(q.query)
        names = [tagged(f"{q.prefix}.{c}", t) for c, t in q.columns]
        if not has_key(df):
            df = R.add_sequence(df, [col(c) for c in df.columns], KEY)
        df = df.select((F.col(KEY) + q.offset).alias(KEY), *(col(c).alias(n) for c, n in zip(value_columns(df), names, strict=True)))
        self._need_store().insert(df)
        return self._done()

    def _load(self, q: Node) -> DataFrame:
        names = [tagged(f"{q.prefix}.{c}", t) for c, t in q.columns] if q.columns is not None else None
        df = files.load_csv(self.spark, q.file, names, q.skip_header or names is None, q.key, q.base, **q.options)
        if names is None:
            df = df.select(KEY, *(col(c).alias(tagged(f"{q.prefix}.{c}", q.tags)) for c in value_columns(df)))
        self._need_store().insert(df)
        return self._done()

    def _outfile(self, q: Node) -> DataFrame:
        files.write_csv(Compiler(self).query(q.query), q.file, q.header, **q.options)
        return self._done()

    def _outfile_stream(self, q: Node) -> DataFrame:
        files.write_streams(Compiler(self).query(q.query), q.file)
        return self._done()

    def _delete(self, q: Node) -> DataFrame:
        store = self._need_store()
        paths = q.paths
        if q.tags is not None:
            check = tag_filter(q.tags)
            paths = [n for p in q.paths for n in expand(store.read(), p, check)]
        store.delete(paths, key_ranges(q.where) if q.where is not None else [(KEY_MIN, KEY_MAX)])
        return self._done()

    def _delete_columns(self, q: Node) -> DataFrame:
        store = self._need_store()
        paths = q.paths if q.tags is None else [n for p in q.paths for n in expand(store.read(), p, tag_filter(q.tags))]
        store.delete(paths)
        return self._done()

    def _clear(self, q: Node) -> DataFrame:
        self._need_store().clear()
        return self._done()

    def _compact(self, q: Node) -> DataFrame:
        self._need_store().compact()
        return self._done()

    def _count_points(self, q: Node) -> DataFrame:
        total = self.store.count_points() if self.store else 0
        for df in self.sources.values():
            names = value_columns(df)
            total += sum(df.agg(*(F.count(col(c)) for c in names)).first()) if names else 0
        return self._rows([(total,)], "Points long")

    def _show_functions(self, q: Node) -> DataFrame:
        rows = [(n, k) for n, (k, _) in sorted(self.functions.items())] + [(n, "TRANSFORM") for n in sorted(self.transforms)]
        return self._rows(rows, "Name string, Type string")

    def _create_function(self, q: Node) -> DataFrame:
        for kind, name, cls in q.functions:
            made = adapter.load_class(q.file, cls)
            if kind == "TRANSFORM":
                self.register_transform(name, lambda frame, m=made: m().transform(frame), getattr(made, "schema", None))
            elif kind == "UDTF":
                self.register_udtf(name, made, getattr(made, "outputs", [(name, "DOUBLE")]))
            elif kind == "UDAF":
                self.register_udaf(name, made, getattr(made, "output", "double"))
            else:
                self.register_udsf(name, made, made.schema)
        return self._done()

    def _drop_function(self, q: Node) -> DataFrame:
        (self.functions if q.name in self.functions else self.transforms).pop(q.name)
        return self._done()

    def _commit_job(self, q: Node) -> DataFrame:
        return self._rows([(self.jobs.commit(read_job(q.file)),)], "JobId long")

    def _job_status(self, q: Node) -> DataFrame:
        return self._rows([(self.jobs.jobs[q.job].state,)], "State string")

    def _cancel_job(self, q: Node) -> DataFrame:
        self.jobs.cancel(q.job)
        return self._done()

    def _show_jobs(self, q: Node) -> DataFrame:
        return self._rows([(i, j.state) for i, j in self.jobs.jobs.items() if q.state in (None, j.state)], "JobId long, State string")

    def _set_config(self, q: Node) -> DataFrame:
        self.spark.conf.set(q.name, q.value)
        return self._done()

    def _show_config(self, q: Node) -> DataFrame:
        rows = [(q.name, self.spark.conf.get(q.name))] if q.name else sorted(self.spark.conf.getAll.items())
        return self._rows(rows, "Name string, Value string")

    def _set_rules(self, q: Node) -> DataFrame:
        off = set(filter(None, self.spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",")))
        for name, on in q.rules.items():
            full = f"org.apache.spark.sql.catalyst.optimizer.{name}"
            off = off - {full} if on else off | {full}
        self.spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(sorted(off)))
        return self._done()

    def _show_rules(self, q: Node) -> DataFrame:
        off = [n.rpartition(".")[2] for n in self.spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if n]
        return self._rows([(n, "OFF") for n in off], "RuleName string, Status string")

    def _show_session(self, q: Node) -> DataFrame:
        return self._rows([(self.id,)], "SessionId long")

    def _show_replicas(self, q: Node) -> DataFrame:
        return self._rows([(1,)], "ReplicaNumber int")

    def _show_cluster(self, q: Node) -> DataFrame:
        return self._rows([(p, "mounted") for p in sorted(self.sources)] + ([(self.store.path, "store")] if self.store else []), "Source string, Kind string")

    def _add_engine(self, q: Node) -> DataFrame:
        """Mounts a file or database source; ``schema_prefix`` puts its columns below a prefix."""
        o = q.options
        prefix = o.get("schema_prefix") or q.engine
        if q.engine in ("parquet", "csv", "tsv", "json"):
            read = {"parquet": files.read_parquet, "json": files.read_json}.get(q.engine, files.read_csv)
            self.sources[prefix] = read(self.spark, o["dir"], prefix, o.get("key"))
        elif q.engine == "raw":
            self.sources[prefix] = files.read_raw(self.spark, o["dir"], prefix)
        elif q.engine in ("postgresql", "mysql", "oracle", "relational"):
            url = o.get("url") or f"jdbc:{'postgresql' if q.engine == 'relational' else q.engine}://{q.host}:{q.port}/{o.get('database', '')}"
            self.sources[prefix] = files.read_jdbc(self.spark, url, o["table"], prefix, o.get("key"), **{k: o[k] for k in ("user", "password") if k in o})
        else:
            raise SqlError(f"no such kind of source: {q.engine}")
        return self._done()

    def _remove_engine(self, q: Node) -> DataFrame:
        self.unmount(q.prefix)
        return self._done()

    # Users are kept for the session; passwords only as digests.

    def _create_user(self, q: Node) -> DataFrame:
        if q.user in self.users:
            raise SqlError(f"user {q.user} exists")
        self.users[q.user] = {"password": hashlib.sha256(q.password.encode()).hexdigest(), "rights": []}
        return self._done()

    def _alter_user(self, q: Node) -> DataFrame:
        self.users[q.user]["password"] = hashlib.sha256(q.password.encode()).hexdigest()
        return self._done()

    def _drop_user(self, q: Node) -> DataFrame:
        del self.users[q.user]
        return self._done()

    def _grant(self, q: Node) -> DataFrame:
        self.users[q.user]["rights"] = q.rights
        return self._done()

    def _show_users(self, q: Node) -> DataFrame:
        return self._rows([(n, ",".join(u["rights"])) for n, u in self.users.items() if not q.users or n in q.users], "Name string, Rights string")

    # Queries without SQL.

    def query_data(self, paths: list[str], start: int, end: int, tags=None) -> DataFrame:
        df = reduce(J.align, self._all(lambda n: True)) if len(self._all(lambda n: True)) > 1 else self._all(lambda n: True)[0]
        return X.query_range(df, [n for p in paths for n in expand(df, p, tags)], start, end)

    def aggregate_query(self, paths: list[str], function: str, start: int, end: int) -> DataFrame:
        df = self.query_data(paths, start, end)
        return X.aggregate_query(df, value_columns(df), function, start, end)

    def downsample_query(self, paths: list[str], function: str, start: int, end: int, size: int) -> DataFrame:
        from .functions.aggregates import aggregate

        df = self.query_data(paths, start, end)
        return downsample(df, size, [aggregate(function, col(c), F.col(KEY)).alias(f"{function}({c})") for c in value_columns(df)], start=start, end=end)

    def query_last(self, paths: list[str]) -> DataFrame:
        df = self.query_data(paths, KEY_MIN, KEY_MAX)
        return X.first_last(df, "last")

    def match_curve(self, paths: list[str], start: int, end: int, curve: list[float], band: int = 5) -> DataFrame:
        df = self.query_data(paths, start, end)
        return curve_match(df, value_columns(df), curve, band)

    def insert_frame(self, frame, prefix: str) -> None:
        """A pandas frame with a ``key`` column."""
        df = self.spark.createDataFrame(frame)
        self._need_store().insert(df.select(F.col(KEY).cast("long").alias(KEY), *(col(c).alias(f"{prefix}.{c}") for c in value_columns(df))))

    def insert_columns(self, paths: list[str], keys: list[int], columns: list[list]) -> None:
        """A list of values for each path, in the order of the keys."""
        self.insert([{KEY: k, **{p: c[i] for p, c in zip(paths, columns, strict=True)}} for i, k in enumerate(keys)])

    def save_as(self, df: DataFrame, path: str) -> DataFrame:
        """Stores a result's one column under a path, by its keys, and gives the result back."""
        (name,) = value_columns(df)
        self._need_store().insert(df.select(KEY, col(name).alias(path)))
        return df

    def fetch(self, df: DataFrame, rows: int = 1000):
        """Pages of rows, without collecting the whole result."""
        page = []
        for row in df.toLocalIterator():
            page.append(row)
            if len(page) == rows:
                yield page
                page = []
        if page:
            yield page


def key_ranges(p: Node) -> list[tuple[int, int]]:
    """The [start, end) ranges of a condition on the key alone."""
    if p.kind == "or":
        return [r for x in p.parts for r in key_ranges(x)]
    if p.kind == "and":
        out = [(KEY_MIN, KEY_MAX)]
        for x in p.parts:
            out = [(max(a, c), min(b, d)) for a, b in out for c, d in key_ranges(x) if max(a, c) < min(b, d)]
        return out
    if p.kind != "compare" or p.left.kind != "path" or p.left.path.lower() != KEY or p.right.kind != "const":
        raise SqlError("points are deleted by their key only")
    v = p.right.value
    return {"=": [(v, v + 1)], "!=": [(KEY_MIN, v), (v + 1, KEY_MAX)], ">": [(v + 1, KEY_MAX)], ">=": [(v, KEY_MAX)], "<": [(KEY_MIN, v)], "<=": [(KEY_MIN, v + 1)]}[p.op]


__all__ = ["Scope", "Session", "key_ranges"]
