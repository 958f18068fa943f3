"""From parsed statements to DataFrames: names, wildcards and tags are resolved here, everything else is Catalyst's.

The order of clauses is: FROM and joins, WHERE with its subqueries, select-list
subqueries, grouping / downsampling / global aggregation / row expressions, HAVING,
DISTINCT, ORDER BY, LIMIT, SEQUENCE, then aliases and the order of columns.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.aggregates import NAMES as SET_FUNCTIONS
from ..functions.aggregates import aggregate
from ..model import KEY, col, expand, has_key, matches, split_tags, tag_and, tag_equals, tag_or, tag_precise, value_columns, without_tags
from ..operators import joins as J
from ..operators import relational as R
from ..operators import setops as U
from ..operators.series import first_last
from ..operators.windows import downsample
from ..udf.adapter import aggregated
from .cut import written
from .lexer import SqlError
from .parser import Node, node

_names = itertools.count()


def fresh(what: str) -> str:
    return f"keyloom_{what}{next(_names)}"


def tag_filter(clause: Node | None):
    if clause is None:
        return None
    if clause.kind == "without_tags":
        return without_tags
    if clause.kind == "precise_tags":
        return tag_precise(clause.sets)
    if clause.kind == "tag":
        return tag_equals(clause.key, clause.value)
    return (tag_or if clause.kind == "tag_or" else tag_and)(*map(tag_filter, clause.parts))


@dataclass
class Scope:
    """The rows that names refer to: full column names, the prefixes that may be left out, and the query around."""

    df: DataFrame
    prefixes: list[str]
    outer: Scope | None = None
    tags: object = None
    joined: list = field(default_factory=list)

    def find(self, name: str) -> list[str]:
        """Columns that a path or pattern names here."""
        if name == KEY and has_key(self.df):
            return [KEY]
        if name in self.df.columns and self.tags is None:
            return [name]
        for p in ["", *(f"{p}." for p in self.prefixes)]:
            found = expand(self.df, p + name, self.tags)
            if found:
                return found
        return []


class Compiler:
    def __init__(self, session):
        self.session = session
        self.ctes: dict[str, DataFrame] = {}
        #: The key that the last row function gave its rows.
        self.row_key: Column | None = None
        #: Where the aggregates of a query without groups leave the keys that they give; None elsewhere.
        self.set_key: list[Column] | None = None

    # Queries.

    def query(self, q: Node, outer: Scope | None = None) -> DataFrame:
        if q.kind == "with":
            saved = dict(self.ctes)
            try:
                for name, columns, inner in q.ctes:
                    df = self.query(inner)
                    names = columns or [c.rsplit(".", 1)[-1] for c in value_columns(df)]
                    df = df.select(*([KEY] if has_key(df) else []), *(col(c).alias(n) for c, n in zip(value_columns(df), names, strict=True)))
                    self.ctes[name] = df
                return self.query(q.query, outer)
            finally:
                self.ctes = saved
        if q.kind == "ordered":
            if q.query.kind == "select":
                return self.select(q.query, outer, q.order, q.limit, q.offset)
            df = self.query(q.query, outer)
            scope = Scope(df, [])
            if q.order:
                df = R.sort(df, [(self.expr(e, scope)[0][0], down) for e, down in q.order])
            return self._limited(df, q.limit, q.offset)
        if q.kind == "set":
            left, right = self.query(q.left, outer), self.query(q.right, outer)
            return {"union": U.union, "except": U.except_, "intersect": U.intersect}[q.op](left, right, q.all)
        if q.kind == "select":
            return self.select(q, outer)
        if q.kind == "show_columns":
            return self.session.columns(q.paths, tag_filter(q.tags), q.limit, q.offset)
        raise SqlError(f"not a query: {q.kind}")

    @staticmethod
    def _limited(df: DataFrame, count, offset) -> DataFrame:
        if offset:
            df = df.offset(offset)
        return df.limit(count) if count is not None else df

    def source(self, s: Node, outer: Scope | None) -> tuple[DataFrame, str | None]:
        if s.kind == "derived":
            df = self.query(s.query, outer)
            if s.alias:
                df = df.select(*(col(c).alias(c if c == KEY else f"{s.alias}.{c}") for c in df.columns))
            return df, s.alias
        path = s.path
        if path in self.ctes:
            df = R.add_prefix(self.ctes[path], s.alias or path)
            return df, s.alias or path
        df = self.session.table(path)
        if s.alias:
            df = df.select(*(col(c).alias(c if c == KEY else s.alias + c.removeprefix(path)) for c in df.columns))
        return df, s.alias or path

    def scope(self, q: Node, outer: Scope | None) -> Scope:
        tags = tag_filter(q.tags)
        if not q.sources:
            return Scope(self.session.spark.range(1).select(F.lit(1).alias("keyloom_one")), [], outer, tags)
        df, prefix = self.source(q.sources[0][1], outer)
        prefixes = [prefix] if prefix else []
        for how, s, kind, detail in q.sources[1:]:
            right, name = self.source(s, outer)
            left_name = prefixes[0] if prefixes else "left"
            names = (left_name, name or "right")
            if kind == "key":
                df = J.using_key(df, right, how)
            elif kind == "natural":
                df = J.natural(df, right, how, names)
            elif kind == "using":
                df = J.using(df, right, [c.removeprefix(f"{left_name}.") for c in detail], how, names)
            elif kind == "on" and detail is not None:
                left, right = J.demoted(df, names[0]), J.demoted(right, names[1])
                both = Scope(left.crossJoin(right), [*prefixes, name] if name else prefixes, outer)
                df = left.join(right, self.condition(detail, both), how)
            elif kind == "on":
                df = J.demoted(df, names[0]).join(J.demoted(right, names[1]), F.lit(True), how)
            else:
                df = J.cross_join(df, right, names)
            if name:
                prefixes.append(name)
        return Scope(df, prefixes, outer, tags)

    def select(self, q: Node, outer: Scope | None, order=(), count=None, offset=0) -> DataFrame:
        if q.meta is not None:
            scope = self.scope(q, outer)
            self._where(q.where, scope)
            paths = R.values_to_paths(self.query(q.meta))
            names = list(dict.fromkeys(n for p in paths for n in scope.find(p)))
            df = scope.df.select(*([KEY] if has_key(scope.df) else []), *map(col, names))
            return self._limited(df, count, offset)
        scope = self.scope(q, outer)
        self._where(q.where, scope)
        if q.window is not None:
            return self._downsampled(q, scope, order, count, offset)
        calls = [c for e, _, _ in q.items for c in self._calls(e)]
        series = [c for c in calls if c.name.lower() in ("first", "last")]
        if series:
            return self._limited(self._first_last(q, scope), count, offset)
        kinds = {self.session.functions[c.name][0] for c in calls if c.name in self.session.functions}
        if "UDSF" in kinds:
            return self._limited(self._set_function(q, scope), count, offset)
        sets = any(c.name.lower() in SET_FUNCTIONS for c in calls) or "UDAF" in kinds or q.having is not None
        if q.group or sets:
            return self._grouped(q, scope, order, count, offset)
        columns, sequences, key = [], [], None
        self.row_key = None
        for e, alias, is_key in q.items:
            if e.kind == "call" and e.name.lower() == "sequence":
                a = [x.value for x in e.args_] or [0, 1]
                sequences.append((alias or f"sequence({a[0]}, {a[1]})", *a))
                columns.append((None, sequences[-1][0]))
                continue
            found = self.expr(e, scope)
            for c, name in found:
                if is_key:
                    key = c
                else:
                    columns.append((c, self._alias(alias, name, e)))
        row_key, self.row_key = self.row_key, None
        plain = [(c, n) for c, n in columns if c is not None]
        df = scope.df
        own_key = has_key(df) and not q.distinct
        hidden = []
        for e, down in order:
            if e.kind == "path" and e.path in [n for _, n in plain] and not scope.find(e.path):
                c = next(c for c, n in plain if n == e.path)
            else:
                c = self.expr(e, scope)[0][0]
            hidden.append((c, fresh("order"), down))
        df = scope.df  # subqueries in expressions may have joined to it
        keyed = [key.cast("long").alias(KEY)] if key is not None else [(F.col(KEY) if row_key is None else row_key).alias(KEY)] if own_key and q.sources else []
        df = df.select(*keyed, *(c.alias(n) for c, n in plain), *(c.alias(n) for c, n, _ in hidden if not q.distinct))
        if q.distinct:
            df = df.distinct()
            by = [(col(next((n for _, n in plain if n == e.path or n.endswith(f".{e.path}")), plain[0][1])), down) for e, down in order]
        else:
            by = [(F.col(n), down) for _, n, down in hidden]
        if by:
            df = R.sort(df, by)
        df = self._limited(df, count, offset)
        for name, start, step in sequences:
            by_columns = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in by] or ([F.col(KEY)] if KEY in df.columns else [])
            df = R.add_sequence(df, by_columns or [col(df.columns[0])], name, start, step)
        df = df.drop(*(n for _, n, _ in hidden))
        if key is not None:
            df = R.as_key(df, KEY)
        return df.select(*([KEY] if KEY in df.columns else []), *(col(n) for _, n in columns))

    @staticmethod
    def _alias(alias: str | None, name: str, e: Node) -> str:
        return name if alias is None else alias

    def _calls(self, e) -> list[Node]:
        if isinstance(e, Node):
            own = [e] if e.kind == "call" else []
            return own if e.kind == "scalar_query" else own + [c for v in e.args.values() for c in self._calls(v)]
        if isinstance(e, (list, tuple)):
            return [c for v in e for c in self._calls(v)]
        return []

    # Grouping.

    def _aggregates(self, e: Node, scope: Scope, made: dict[str, Column]) -> list[tuple[Column, str]]:
        """An expression over set functions, as one over the columns that the aggregation makes of them."""
        if e.kind == "call" and self.session.functions.get(e.name, ("",))[0] == "UDAF":
            paths, args = [a for a in e.args_ if a.kind != "const"], [a.value for a in e.args_ if a.kind == "const"]
            found = [self.expr(a, scope) for a in paths]
            out = []
            # One path stands for a call on each of its columns, several for one call on all.
            for columns in [[f] for f in found[0]] if len(found) == 1 else [[f for part in found for f in part]]:
                label = f"{e.name.lower()}({', '.join(n for _, n in columns)})"
                # Calls with other arguments are other columns.
                own = f"{label}{args}{e.named}" if args or e.named else label
                made[own], key = self.session.functions[e.name][1](columns, F.col(KEY) if has_key(scope.df) else None, args, e.named)
                if key is not None and self.set_key is not None:
                    self.set_key.append(key)
                out.append((col(own), label))
            return out
        if e.kind == "call" and e.name.lower() in SET_FUNCTIONS:
            out = []
            for c, name in self.expr(e.args_[0], scope):
                label = f"{e.name.lower()}({'distinct ' if e.distinct else ''}{name})"
                made[label] = aggregate(e.name, c, F.col(KEY) if has_key(scope.df) else None, e.distinct)
                out.append((col(label), label))
            return out
        if e.kind in ("binary", "negate", "bracket", "case", "call"):
            return self.expr(e, scope, lambda x: self._aggregates(x, scope, made))
        return self.expr(e, scope)

    def _grouped(self, q: Node, scope: Scope, order, count, offset) -> DataFrame:
        groups = [self.expr(g, scope)[0] for g in q.group]
        names = {n: n for _, n in groups}
        aliases = {alias: e for e, alias, _ in q.items if alias}
        made: dict[str, Column] = {}
        outputs = []
        grouped = Scope(scope.df, scope.prefixes, scope.outer, scope.tags)

        def over(e: Node):
            if not self._calls(e) or all(c.name.lower() not in SET_FUNCTIONS and self.session.functions.get(c.name, ("",))[0] != "UDAF" for c in self._calls(e)):
                found = self.expr(e, grouped)
                if e.kind == "const":
                    return found
                if all(n in names for _, n in found):
                    return [(col(n), n) for _, n in found]
                if not q.group and e.kind == "scalar_query":
                    return found
                if e.kind == "path" and e.path in aliases:
                    return over(aliases[e.path])
            return self._aggregates(e, grouped, made)

        self.set_key = None if groups else []
        for e, alias, _ in q.items:
            for c, n in over(e):
                outputs.append((c, alias or n))
        if self.set_key:
            made[KEY] = self.set_key[0]
            outputs.insert(0, (F.col(KEY), KEY))
        self.set_key = None
        condition = self.condition(q.having, grouped, over) if q.having is not None else None
        by = []
        for e, down in order:
            if e.kind == "path" and e.path in [n for _, n in outputs]:
                by.append((next(c for c, n in outputs if n == e.path), down))
            else:
                by.append((over(e)[0][0], down))
        base = grouped.df.withColumns({}) if not groups else grouped.df
        built = [c.alias(n) for n, c in made.items()]
        if groups:
            keys = [c.alias(n) for c, n in groups]
            df = aggregated(base, keys, built) if built else base.select(*keys).distinct()
        else:
            df = aggregated(base, [], built)
        for extra, on in grouped.joined:
            df = df.crossJoin(extra) if on is None else df
        if condition is not None:
            df = df.where(condition)
        if q.distinct:
            df = df.select(*(c.alias(n) for c, n in outputs)).distinct()
            return self._limited(R.sort(df, [(col(n), d) for (c, d), n in zip(by, [n for _, n in outputs], strict=False)]) if by else df, count, offset)
        if by:
            df = R.sort(df, by)
        return self._limited(df, count, offset).select(*(c.alias(n) for c, n in outputs))

    def _downsampled(self, q: Node, scope: Scope, order, count, offset) -> DataFrame:
        made: dict[str, Column] = {}
        outputs = []
        for e, alias, _ in q.items:
            if e.kind == "case":
                raise SqlError("CASE isn't allowed with OVER WINDOW")
            for c, n in self._aggregates(e, scope, made):
                outputs.append((c, alias or n))
        start, end = q.window.interval or (None, None)
        df = downsample(scope.df, q.window.size, [c.alias(n) for n, c in made.items()], q.window.slide, start, end)
        df = df.select(KEY, "window_start", "window_end", *(c.alias(n) for c, n in outputs))
        df = R.sort(df, [(self.expr(e, Scope(df, []))[0][0], d) for e, d in order]) if order else df
        return self._limited(df, count, offset)

    def _first_last(self, q: Node, scope: Scope) -> DataFrame:
        parts = []
        for e, _, _ in q.items:
            names = [n for a in e.args_ for _, n in self.expr(a, scope)]
            parts.append(first_last(scope.df, e.name.lower(), names))
        return reduce(DataFrame.unionByName, parts)

    def _set_function(self, q: Node, scope: Scope) -> DataFrame:
        if len(q.items) != 1 or q.items[0][0].kind != "call":
            raise SqlError("a UDSF stands alone in a select list")
        e = q.items[0][0]
        names = [n for a in e.args_ if a.kind == "path" for _, n in self.expr(a, scope)]
        return self.session.functions[e.name][1](scope.df.select(*([KEY] if has_key(scope.df) else []), *map(col, names)), [a.value for a in e.args_ if a.kind == "const"], e.named)

    # Predicates.

    def _where(self, where: Node | None, scope: Scope) -> None:
        if where is None:
            return
        where = self._positive(where, False)
        for part in where.parts if where.kind == "and" else [where]:
            if part.kind == "exists":
                inner, on = self._inner(part.query, scope)
                scope.df = J.exists(scope.df, inner, on, part.negated)
            elif part.kind == "in_query":
                left = self.expr(part.left, scope)[0][0]
                inner, on = self._inner(part.query, scope)
                value = col(value_columns(inner)[0])
                test = (left == value) if on is None else (left == value) & on
                scope.df = scope.df.join(inner, test, "left_anti" if part.negated else "left_semi")
                if part.negated:
                    scope.df = scope.df.where(left.isNotNull())
            elif part.kind == "quantified":
                left = self.expr(part.left, scope)[0][0]
                inner, on = self._inner(part.query, scope)
                if on is None:
                    scope.df = J.quantified(scope.df, left, part.op, inner, part.which == "all")
                else:
                    value = col(value_columns(inner)[0])
                    op = S.OPPOSITE[part.op] if part.which == "all" else part.op
                    scope.df = scope.df.join(inner, on & S.COMPARE[op](left, value), "left_anti" if part.which == "all" else "left_semi")
            else:
                test = self.condition(part, scope)
                scope.df = scope.df.where(test)

    def _positive(self, p: Node, negated: bool) -> Node:
        """NOT pushed to the leaves, so that a comparison with null is false either way."""
        if p.kind == "not":
            return self._positive(p.of, not negated)
        if p.kind in ("and", "or"):
            kind = p.kind if not negated else {"and": "or", "or": "and"}[p.kind]
            return node(kind, parts=[self._positive(x, negated) for x in p.parts])
        if not negated:
            return p
        if p.kind == "compare":
            mode = {"&": "|", "|": "&", None: "&" if self._wild(p.left) else None}[p.mode]
            return node("compare", left=p.left, op=S.OPPOSITE[p.op], right=p.right, mode=mode)
        if p.kind == "bool":
            return node("bool", value=not p.value)
        if p.kind == "quantified":
            return node("quantified", left=p.left, op=S.OPPOSITE[p.op], which={"all": "any", "any": "all"}[p.which], query=p.query)
        return Node(p.kind, {**p.args, "negated": not p.negated})

    @staticmethod
    def _wild(e: Node) -> bool:
        return e.kind == "path" and "*" in e.path

    def condition(self, p: Node, scope: Scope, over=None) -> Column:
        """A filter's or join's condition.  As NOT is pushed to the leaves, null fails like false and comparisons stay bare, which gives joins their keys and scans their filters."""
        p = self._positive(p, False)
        value = over or (lambda e: self.expr(e, scope))
        if p.kind == "and":
            return reduce(lambda a, b: a & b, (self.condition(x, scope, over) for x in p.parts))
        if p.kind == "or":
            return reduce(lambda a, b: a | b, (self.condition(x, scope, over) for x in p.parts))
        if p.kind == "bool":
            return F.lit(p.value)
        if p.kind == "compare":
            tests = [self._compared(a, p.op, b) for (a, _), (b, _) in itertools.product(value(p.left), value(p.right))]
            return reduce((lambda a, b: a & b) if p.mode == "&" else (lambda a, b: a | b), tests)
        if p.kind == "like":
            tests = [~S.matches_like(c, p.pattern) if p.negated else S.matches_like(c, p.pattern) for c, _ in value(p.left)]
            return reduce((lambda a, b: a & b) if (p.mode == "&" or (p.negated and p.mode is None)) else (lambda a, b: a | b), tests)
        if p.kind == "in":
            bare = bool(p.values) and None not in p.values
            tests = [(~c.isin(p.values) if p.negated else c.isin(p.values)) if bare else R.in_list(c, p.values, p.negated) for c, _ in value(p.left)]
            return reduce((lambda a, b: a & b) if (p.mode == "&" or (p.negated and p.mode is None)) else (lambda a, b: a | b), tests)
        if p.kind in ("exists", "in_query"):
            return self._marked(p, scope)
        if p.kind == "quantified":
            return self._quantified(p, scope)
        raise SqlError(f"{p.kind} isn't supported under OR")

    @staticmethod
    def _compared(a: Column, op: str, b: Column) -> Column:
        return S.COMPARE[op](a, b)

    def _inner(self, q: Node, scope: Scope) -> tuple[DataFrame, Column | None]:
        """A subquery's rows under names of their own, and the conditions that tie it to the query around it."""
        body = q.query if q.kind == "ordered" else q
        if body.kind != "select" or q.kind == "ordered" or body.group or body.having is not None:
            df = self.query(q, scope)
            return df.toDF(*(fresh("sub") for _ in df.columns)) if not has_key(df) else df.drop(KEY).toDF(*(fresh("sub") for _ in value_columns(df))), None
        inner = self.scope(body, scope)
        new = {c: fresh("sub") for c in inner.df.columns}
        parts = []
        if body.where is not None:
            where = self._positive(body.where, False)
            parts = where.parts if where.kind == "and" else [where]
        outer_parts = [p for p in parts if self._refers_out(p, inner, scope)]
        own = [p for p in parts if not any(p is o for o in outer_parts)]
        if own:
            self._where(node("and", parts=own), inner)
        if any(c.name.lower() in SET_FUNCTIONS for e, _, _ in body.items for c in self._calls(e)) and outer_parts:
            return self._correlated_aggregate(body, inner, outer_parts, scope)
        if not outer_parts:
            rest = Node("select", {**body.args, "where": None})
            df = self._selected(rest, inner)
            df = df.drop(KEY) if has_key(df) else df
            return df.toDF(*(fresh("sub") for _ in df.columns)), None
        values = [(c, fresh("sub")) for e, _, _ in body.items for c, _ in self.expr(e, inner)]
        df = inner.df.select(*(c.alias(n) for c, n in values), *(col(c).alias(new[c]) for c in inner.df.columns))
        both = _Both(inner, scope, new)
        return df, reduce(lambda a, b: a & b, (self.condition(p, both) for p in outer_parts))

    def _selected(self, q: Node, scope: Scope) -> DataFrame:
        """A select list over rows that are there already."""
        keep = self.scope
        self.scope = lambda *_: scope  # type: ignore[method-assign]
        try:
            return self.select(q, scope.outer)
        finally:
            self.scope = keep  # type: ignore[method-assign]

    def _paths(self, e) -> list[str]:
        if isinstance(e, Node):
            return [e.path] if e.kind == "path" else [p for v in e.args.values() for p in self._paths(v)]
        if isinstance(e, (list, tuple)):
            return [p for v in e for p in self._paths(v)]
        return []

    def _refers_out(self, p: Node, inner: Scope, outer: Scope) -> bool:
        return any(not inner.find(x) and outer.find(x) for x in self._paths(p))

    def _correlated_aggregate(self, q: Node, inner: Scope, ties: list[Node], outer: Scope):
        """``(SELECT f(x) FROM t WHERE t.a = outer.b)``: t is grouped by a and joined on it."""
        keys, tests = [], []
        for p in ties:
            if p.kind != "compare" or p.op != "=":
                raise SqlError("a correlated set function needs equalities with the query around it")
            mine, theirs = (p.left, p.right) if self._paths(p.left) and inner.find(self._paths(p.left)[0]) else (p.right, p.left)
            name = fresh("sub")
            keys.append(self.expr(mine, inner)[0][0].alias(name))
            tests.append(self.expr(theirs, outer)[0][0] == F.col(name))
        made: dict[str, Column] = {}
        c, _ = self._aggregates(q.items[0][0], inner, made)[0]
        df = aggregated(inner.df, keys, [v.alias(n) for n, v in made.items()])
        name = fresh("sub")
        return df.withColumn(name, c).select(F.col(name), *(k for k in df.columns if k.startswith("keyloom_sub"))), reduce(lambda a, b: a & b, tests)

    def _marked(self, p: Node, scope: Scope) -> Column:
        """EXISTS or IN under OR: the row's match with distinct keys of the subquery, as a boolean column."""
        inner, on = self._inner(p.query, scope)
        if p.kind == "in_query":
            left = self.expr(p.left, scope)[0][0]
            test = left == col(value_columns(inner)[0])
            on = test if on is None else on & test
        hit = self._hit(inner, on, scope)
        if not p.negated:
            return hit
        return ~hit & left.isNotNull() if p.kind == "in_query" else ~hit

    def _hit(self, inner: DataFrame, on: Column | None, scope: Scope) -> Column:
        """Whether the row has a match in the subquery, as a boolean column that is added to the rows."""
        name = fresh("mark")
        if on is None:
            scope.df = scope.df.crossJoin(inner.limit(1).agg((F.count("*") > 0).alias(name)))  # one row
        else:
            row = fresh("row")
            # Numbered once, as both sides of the join below must agree on the numbers.
            rows = written(scope.df.withColumn(row, F.monotonically_increasing_id()))
            hits = rows.join(inner, on, "left_semi").select(F.col(row), F.lit(True).alias(name))
            scope.df = rows.join(hits, row, "left").drop(row)
        return S.truth(F.col(name))

    def _quantified(self, p: Node, scope: Scope) -> Column:
        """ANY or ALL under OR, as a boolean: equality is a match (or none), an order is decided on the extremes of the subquery."""
        left = self.expr(p.left, scope)[0][0]
        inner, on = self._inner(p.query, scope)
        every = p.which == "all"
        value = col(value_columns(inner)[0])
        if on is not None or (p.op in ("=", "!=") and (p.op == "=") != every):
            # Some row compares true; or, for ALL, none compares false.
            test = S.COMPARE[S.OPPOSITE[p.op] if every else p.op](left, value)
            hit = self._hit(inner.where(value.isNotNull()), test if on is None else on & test, scope)
            return ~hit & left.isNotNull() if every else hit
        lo, hi, n = fresh("lo"), fresh("hi"), fresh("n")
        scope.df = scope.df.crossJoin(inner.agg(F.min(value).alias(lo), F.max(value).alias(hi), F.count(value).alias(n)))  # one row
        if p.op in ("=", "!="):
            same = (F.col(lo) == F.col(hi)) & (left == F.col(lo))
            return same | (F.col(n) == 0) if every else ~same & (F.col(n) > 0)
        bound = F.col(hi if (p.op in (">", ">=")) == every else lo)
        test = S.COMPARE[p.op](left, bound)
        return test | (F.col(n) == 0) if every else test

    # Expressions.

    def expr(self, e: Node, scope: Scope, sub=None) -> list[tuple[Column, str]]:
        """The columns that an expression stands for (several if it has a wildcard), each with its name."""
        sub = sub or (lambda x: self.expr(x, scope))
        if e.kind == "const":
            return [(F.lit(e.value), _text(e.value))]
        if e.kind == "path":
            found = scope.find(e.path if e.path.lower() != KEY else KEY)
            if found:
                return [(scope.column(n) if isinstance(scope, _Both) else col(n), n) for n in found]
            if scope.outer is not None and (found := scope.outer.find(e.path)):
                return [(col(n), n) for n in found]
            if isinstance(scope, _Both):
                raise SqlError(f"no such column: {e.path}")
            if "*" in e.path:
                return []
            raise SqlError(f"no such column: {e.path}")
        if e.kind == "bracket":
            return [(c, f"({n})") for c, n in sub(e.of)]
        if e.kind == "negate":
            return [(-c, f"-{n}") for c, n in sub(e.of)]
        if e.kind == "binary":
            make = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": S.divide, "%": S.modulo}[e.op]
            return [(make(a, b), f"{m} {_SIGN[e.op]} {n}") for (a, m), (b, n) in itertools.product(sub(e.left), sub(e.right))]
        if e.kind == "case":
            over = sub
            branches = [(self.condition(w, scope, over), over(t)[0][0]) for w, t in e.branches]
            out = S.case_when(branches, over(e.otherwise)[0][0] if e.otherwise is not None else None)
            return [(out, e.text)]
        if e.kind == "scalar_query":
            return [self._scalar(e.query, scope)]
        if e.kind == "call":
            return self._call(e, sub, scope)
        raise SqlError(f"not an expression: {e.kind}")

    def _scalar(self, q: Node, scope: Scope) -> tuple[Column, str]:
        inner, on = self._inner(q, scope)
        name = value_columns(inner)[0]
        if on is None:
            one = inner.agg(F.count("*").alias("n"), F.first(col(name)).alias(name))
            one = one.select(F.when(F.assert_true(F.col("n") <= 1, F.lit("a scalar subquery has more than one row")).isNull(), F.col(name)).alias(name))
            scope.df = scope.df.crossJoin(one)  # one row
            scope.joined.append((one, None))
        elif q.kind == "select" and any(c.name.lower() in SET_FUNCTIONS for e, _, _ in q.items for c in self._calls(e)):
            scope.df = scope.df.join(inner, on, "left")  # grouped by what it is joined on
        else:
            scope.df = J.single(scope.df, inner, on, name)
        return F.col(name), "subquery"

    def _call(self, e: Node, sub, scope: Scope) -> list[tuple[Column, str]]:
        name = e.name.lower()
        if name == "extract":
            return [(S.extract(c, e.args_[1].value), f"extract({n}, {e.args_[1].value})") for c, n in sub(e.args_[0])]
        if name == "substring":
            start, length = e.args_[1].value, e.args_[2].value
            return [(S.substring(c, start, length), f"substring({n}, {start}, {length})") for c, n in sub(e.args_[0])]
        if name == "ratio":
            return [(S.ratio(a, b), f"ratio({m}, {n})") for (a, m), (b, n) in itertools.product(sub(e.args_[0]), sub(e.args_[1]))]
        if e.name in self.session.functions and self.session.functions[e.name][0] == "UDTF":
            columns = [x for a in e.args_ if a.kind != "const" for x in sub(a)]
            constants = [a.value for a in e.args_ if a.kind == "const"]
            out, key = self.session.functions[e.name][1](columns, constants, e.named, F.col(KEY) if has_key(scope.df) else None)
            self.row_key = key if has_key(scope.df) else None
            return out
        if name in S.NATIVE:
            args = [sub(a) for a in e.args_]
            return [(S.NATIVE[name](*(c for c, _ in combo)), f"{name}({', '.join(n for _, n in combo)})") for combo in itertools.product(*args)]
        raise SqlError(f"no such function: {e.name}")


_SIGN = {"+": "+", "-": "-", "*": "×", "/": "÷", "%": "%"}


def _text(value) -> str:
    return "'" + value + "'" if isinstance(value, str) else str(value)


class _Both(Scope):
    """A subquery's columns under new names, and behind them those of the query around it."""

    def __init__(self, inner: Scope, outer: Scope, new: dict[str, str]):
        super().__init__(inner.df, inner.prefixes, None, inner.tags)
        self.behind, self.new = outer, new

    def find(self, name: str) -> list[str]:
        return super().find(name) or self.behind.find(name)

    def column(self, name: str) -> Column:
        return F.col(self.new[name]) if name in self.new and (name not in self.behind.df.columns or Scope.find(self, name)) else col(name)


__all__ = ["Compiler", "Scope", "SqlError", "matches", "split_tags", "tag_filter"]
