"""Recursive-descent parser of the SQL dialect: text to a tree of nodes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.scalar import date_nanos, duration
from .lexer import SqlError, Token, tokens


@dataclass
class Node:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


def node(kind: str, **args: Any) -> Node:
    return Node(kind, args)


#: Words that end a name without AS.
_STOP = set("FROM WHERE GROUP ORDER LIMIT OFFSET HAVING UNION EXCEPT INTERSECT ON USING JOIN INNER LEFT RIGHT FULL NATURAL CROSS OUTER AND OR NOT IN LIKE AS OVER THEN ELSE END WHEN ASC DESC WITH WITHOUT WITH_PRECISE INTO BY SELECT VALUES".split())
_COMPARE = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


class Parser:
    def __init__(self, sql: str):
        self.toks = tokens(sql)
        self.i = 0

    # Tokens.

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def word(self, *words: str, at: int = 0) -> bool:
        return all((t := self.peek(at + j)).kind == "name" and t.text.upper() == w for j, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(" ".join(words))

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            self.i += 1
            return self.toks[self.i - 1].text
        return None

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(text)

    def fail(self, wanted: str):
        raise SqlError(f"expected {wanted} at {self.tok.at}, found {self.tok.text!r}")

    def string(self) -> str:
        if self.tok.kind != "string":
            self.fail("a string")
        self.i += 1
        return self.toks[self.i - 1].text

    def integer(self) -> int:
        sign = -1 if self.op("-") else 1
        if self.tok.kind != "number" or not self.tok.text.isdigit():
            self.fail("an integer")
        self.i += 1
        return sign * int(self.toks[self.i - 1].text)

    def name(self) -> str:
        if self.tok.kind in ("name", "quoted"):
            self.i += 1
            return self.toks[self.i - 1].text
        if self.op("*"):
            return "*"
        self.fail("a name")

    def path(self) -> str:
        parts = [self.name()]
        while self.op("."):
            if self.tok.kind == "number":  # a node may be digits
                parts.append(self.tok.text)
                self.i += 1
            else:
                parts.append(self.name())
        return ".".join(parts)

    # Statements.

    def statement(self) -> Node:
        out = self._statement()
        self.op(";")
        if self.tok.kind != "end":
            self.fail("the end")
        return out

    def _statement(self) -> Node:
        if self.take("INSERT", "INTO"):
            return self.insert()
        if self.take("LOAD", "DATA", "FROM", "INFILE"):
            return self.load()
        if self.take("DELETE", "COLUMNS"):
            return node("delete_columns", paths=self.listed(self.path), tags=self.tag_clause())
        if self.take("DELETE", "FROM"):
            paths = self.listed(self.path)
            where = self.disjunction() if self.take("WHERE") else None
            return node("delete", paths=paths, where=where, tags=self.tag_clause())
        if self.take("CLEAR", "DATA"):
            return node("clear")
        if self.take("COUNT", "POINTS"):
            return node("count_points")
        if self.take("COMPACT"):
            return node("compact")
        if self.take("SHOW"):
            return self.show()
        if self.take("CREATE", "FUNCTION"):
            kind = self.name().upper()
            found = []
            while True:
                name = self.string()
                self.need("FROM")
                found.append((kind, name, self.string()))
                if not self.op(","):
                    break
                if self.tok.kind == "name":
                    kind = self.name().upper()
            self.need("IN")
            return node("create_function", functions=found, file=self.string())
        if self.take("DROP", "FUNCTION"):
            return node("drop_function", name=self.string())
        if self.take("COMMIT", "TRANSFORM", "JOB"):
            return node("commit_job", file=self.string())
        if self.take("CANCEL", "TRANSFORM", "JOB"):
            return node("cancel_job", job=self.integer())
        if self.take("SET", "CONFIG"):
            return node("set_config", name=self.string(), value=self.string())
        if self.take("SET", "RULES"):
            rules = self.listed(lambda: (self.name(), self.need_op("="), self.name().upper() == "ON"))
            return node("set_rules", rules={r[0]: r[2] for r in rules})
        if self.take("ADD", "STORAGEENGINE"):
            return self.add_engine()
        if self.take("REMOVE", "STORAGEENGINE"):
            return node("remove_engine", prefix=self.string())
        if self.take("CREATE", "USER"):
            user = self.name()
            self.need("IDENTIFIED", "BY")
            return node("create_user", user=user, password=self.name())
        if self.take("ALTER", "USER"):
            user = self.name()
            self.need("IDENTIFIED", "BY")
            return node("alter_user", user=user, password=self.name())
        if self.take("DROP", "USER"):
            return node("drop_user", user=self.name())
        if self.take("GRANT"):
            rights = self.listed(lambda: self.name().upper())
            self.need("TO", "USER")
            return node("grant", rights=rights, user=self.name())
        explain = None
        if self.take("EXPLAIN"):
            explain = "physical" if self.take("PHYSICAL") else (self.take("LOGICAL"), "logical")[1]
        out = self.full_query()
        if self.take("INTO", "OUTFILE"):
            out = self.outfile(out)
        return node("explain", query=out, mode=explain) if explain else out

    def listed(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    def show(self) -> Node:
        if self.take("COLUMNS"):
            return self.show_columns()
        for words, kind in ((("FUNCTIONS",), "show_functions"), (("REPLICA", "NUMBER"), "show_replicas"), (("CLUSTER", "INFO"), "show_cluster"), (("SESSIONID",), "show_session"), (("RULES",), "show_rules")):
            if self.take(*words):
                return node(kind)
        if self.take("CONFIG"):
            return node("show_config", name=self.string() if self.tok.kind == "string" else None)
        if self.take("USER"):
            return node("show_users", users=self.listed(self.name) if self.tok.kind in ("name", "quoted") else [])
        if self.take("TRANSFORM", "JOB", "STATUS"):
            return node("job_status", job=self.integer())
        state = None if self.word("TRANSFORM") else self.name().upper()
        self.need("TRANSFORM", "JOBS")
        return node("show_jobs", state=state)

    def show_columns(self) -> Node:
        paths = self.listed(self.path) if (self.tok.kind in ("name", "quoted") and not self.word("WITH") and not self.word("LIMIT") and not self.word("WITHOUT") and not self.word("WITH_PRECISE") and not self.word("OFFSET")) or self.tok.text == "*" else ["*"]
        tags = self.tag_clause()
        count, offset = self.limit()
        return node("show_columns", paths=paths, tags=tags, limit=count, offset=offset)

    def tags(self) -> dict[str, str]:
        out = {}
        if self.op("["):
            while True:
                k = self.name()
                self.need_op("=")
                out[k] = self.string() if self.tok.kind == "string" else self.name()
                if not self.op(","):
                    break
            self.need_op("]")
        return out

    def tag_clause(self) -> Node | None:
        if self.take("WITHOUT", "TAG"):
            return node("without_tags")
        if self.take("WITH_PRECISE"):
            groups = [[]]
            while True:
                k = self.name()
                self.need_op("=")
                groups[-1].append((k, self.string() if self.tok.kind == "string" else self.name()))
                if self.take("OR") or self.op("||", "|"):
                    groups.append([])
                elif not (self.take("AND") or self.op("&&", "&")):
                    return node("precise_tags", sets=[dict(g) for g in groups])
        if self.take("WITH"):
            return self.tag_or()
        return None

    def tag_or(self) -> Node:
        parts = [self.tag_and()]
        while self.take("OR") or self.op("||", "|"):
            parts.append(self.tag_and())
        return node("tag_or", parts=parts)

    def tag_and(self) -> Node:
        def one() -> Node:
            if self.op("("):
                out = self.tag_or()
                self.need_op(")")
                return out
            k = self.name()
            self.need_op("=")
            return node("tag", key=k, value=self.string() if self.tok.kind == "string" else self.name())

        parts = [one()]
        while self.take("AND") or self.op("&&", "&"):
            parts.append(one())
        return node("tag_and", parts=parts)

    def insert(self) -> Node:
        prefix, tags = self.path(), self.tags()
        self.need_op("(")
        self.need("KEY")
        columns = []
        while self.op(","):
            columns.append((self.path(), {**tags, **self.tags()}))
        self.need_op(")")
        self.need("VALUES")
        if self.tok.text == "(" and (self.word("SELECT", at=1) or self.word("WITH", at=1)):
            self.need_op("(")
            query = self.full_query()
            self.need_op(")")
            offset = 0
            if self.take("TIME_OFFSET"):
                self.need_op("=")
                offset = self.integer()
            return node("insert_select", prefix=prefix, columns=columns, query=query, offset=offset)
        rows = []
        while True:
            self.op(",")
            if not self.op("("):
                break
            row = [self.time()]
            while self.op(","):
                row.append(self.constant())
            self.need_op(")")
            rows.append(row)
        return node("insert", prefix=prefix, columns=columns, rows=rows)

    def csv_options(self) -> dict[str, str]:
        self.need("AS", "CSV")
        out = {}
        if self.take("FIELDS"):
            if self.take("TERMINATED", "BY"):
                out["sep"] = self.string()
            if self.take("OPTIONALLY", "ENCLOSED", "BY") or self.take("ENCLOSED", "BY"):
                out["quote"] = self.string()
            if self.take("ESCAPED", "BY"):
                out["escape"] = self.string()
        if self.take("LINES", "TERMINATED", "BY"):
            out["lineSep"] = self.string()
        return out

    def load(self) -> Node:
        file = self.string()
        options = self.csv_options()
        skip = self.take("SKIPPING", "HEADER")
        self.need("INTO")
        prefix, tags = self.path(), self.tags()
        columns, key, base = None, None, 0
        if self.op("("):
            self.need("KEY")
            columns = []
            while self.op(","):
                columns.append((self.path(), {**tags, **self.tags()}))
            self.need_op(")")
        elif self.take("SET", "KEY"):
            key = self.string()
        if self.take("AT"):
            base = self.integer()
        return node("load", file=file, options=options, skip_header=skip, prefix=prefix, tags=tags, columns=columns, key=key, base=base)

    def outfile(self, query: Node) -> Node:
        file = self.string()
        if self.take("AS", "STREAM"):
            return node("outfile_stream", query=query, file=file)
        options = self.csv_options()
        return node("outfile", query=query, file=file, options=options, header=self.take("WITH", "HEADER"))

    def add_engine(self) -> Node:
        self.need_op("(")
        host = self.string()
        self.need_op(",")
        port = self.integer()
        self.need_op(",")
        kind = self.string()
        self.need_op(",")
        self.need("OPTIONS")
        self.need_op("(")
        options = {}
        while True:
            key = self.path()
            self.op("=")
            options[key] = self.string()
            if not self.op(","):
                break
        self.need_op(")")
        self.need_op(")")
        return node("add_engine", host=host, port=port, engine=kind, options=options)

    # Queries.

    def full_query(self) -> Node:
        ctes = []
        if self.word("WITH") and self.peek().kind in ("name", "quoted"):
            self.i += 1

            def cte():
                name = self.name()
                columns = None
                if self.op("("):
                    columns = self.listed(self.name)
                    self.need_op(")")
                self.need("AS")
                self.need_op("(")
                query = self.ordered_query()
                self.need_op(")")
                return name, columns, query

            ctes = self.listed(cte)
        query = self.ordered_query()
        return node("with", ctes=ctes, query=query) if ctes else query

    def ordered_query(self) -> Node:
        query = self.set_query()
        order = []
        if self.take("ORDER", "BY"):
            order = self.listed(self.order_item)
        count, offset = self.limit()
        if not order and count is None and not offset:
            return query
        return node("ordered", query=query, order=order, limit=count, offset=offset)

    def order_item(self):
        what = self.expression()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return what, down

    def limit(self):
        count, offset = None, 0
        for _ in range(2):
            if self.take("LIMIT"):
                count = self.integer()
            elif self.take("OFFSET"):
                offset = self.integer()
        return count, offset

    def set_query(self) -> Node:
        left = self.intersect_query()
        while self.word("UNION") or self.word("EXCEPT"):
            kind = self.name().lower()
            all_rows = self.take("ALL")
            if not all_rows:
                self.take("DISTINCT")
            left = node("set", op=kind, all=all_rows, left=left, right=self.intersect_query())
        return left

    def intersect_query(self) -> Node:
        left = self.simple_query()
        while self.take("INTERSECT"):
            all_rows = self.take("ALL")
            if not all_rows:
                self.take("DISTINCT")
            left = node("set", op="intersect", all=all_rows, left=left, right=self.simple_query())
        return left

    def simple_query(self) -> Node:
        if self.op("("):
            out = self.ordered_query()
            self.need_op(")")
            return out
        self.need("SELECT")
        if self.take("VALUE2META"):
            self.need_op("(")
            inner = self.ordered_query()
            self.need_op(")")
            items, meta, distinct = [], inner, False
        else:
            meta, distinct = None, self.take("DISTINCT")
            items = self.listed(self.select_item)
        sources, where, tags, group, having, window = [], None, None, [], None, None
        if self.take("FROM"):
            sources = self.sources()
            if self.take("WHERE"):
                where = self.disjunction()
            if self.word("WITH") or self.word("WITHOUT") or self.word("WITH_PRECISE"):
                tags = self.tag_clause()
            if self.take("GROUP", "BY"):
                group = self.listed(self.expression)
                if self.take("HAVING"):
                    having = self.disjunction()
            elif self.take("OVER", "WINDOW"):
                window = self.window()
        return node("select", items=items, meta=meta, distinct=distinct, sources=sources, where=where, tags=tags, group=group, having=having, window=window)

    def select_item(self):
        what = self.expression()
        if self.take("AS"):
            if self.take("KEY"):
                return what, None, True
            return what, self.name(), False
        if self.tok.kind in ("name", "quoted") and (self.tok.kind == "quoted" or self.tok.text.upper() not in _STOP):
            return what, self.name(), False
        return what, None, False

    def window(self) -> Node:
        self.need_op("(")
        self.need("SIZE")
        size, slide, interval = self.length(), None, None
        if self.take("IN"):
            opens = self.op("[", "(")
            start = self.time()
            self.need_op(",")
            end = self.time()
            closes = self.op("]", ")")
            interval = (start + (opens == "("), end + (closes == "]"))
        if self.take("SLIDE"):
            slide = self.length()
        self.need_op(")")
        return node("window", size=size, slide=slide, interval=interval)

    def length(self) -> int:
        if self.tok.kind in ("duration", "number"):
            self.i += 1
            return duration(self.toks[self.i - 1].text)
        self.fail("a length")

    def time(self) -> int:
        negative = bool(self.op("-"))
        if self.take("INF"):
            return -(2**63) + 1 if negative else 2**63 - 1
        if self.take("NOW"):
            from ..functions.scalar import now

            self.need_op("(")
            self.need_op(")")
            value = now()
        elif self.tok.kind == "date":
            value = date_nanos(self.tok.text)
            self.i += 1
        else:
            return -self.integer() if negative else self.integer()
        while self.tok.kind == "op" and self.tok.text in "+-" and self.peek().kind in ("duration", "number"):
            sign = 1 if self.op("+", "-") == "+" else -1
            value += sign * self.length()
        return value

    def sources(self) -> list:
        out = [("cross", self.source(), None, None)]
        while True:
            if self.op(",") or self.take("CROSS", "JOIN"):
                out.append(("cross", self.source(), None, None))
                continue
            natural = self.take("NATURAL")
            how = "inner"
            for kind in ("LEFT", "RIGHT", "FULL"):
                if self.take(kind):
                    how = kind.lower()
                    self.take("OUTER")
            self.take("INNER")
            if not self.take("JOIN"):
                if natural or how != "inner":
                    self.fail("JOIN")
                return out
            source = self.source()
            if natural:
                out.append((how, source, "natural", None))
            elif self.take("ON"):
                out.append((how, source, "on", self.disjunction()))
            elif self.take("USING"):
                if self.take("KEY"):
                    out.append((how, source, "key", None))
                else:
                    bracket = self.op("(")
                    columns = self.listed(self.path)
                    if bracket:
                        self.need_op(")")
                    out.append((how, source, "using", columns))
            else:
                out.append((how, source, "cross" if how == "inner" else "on", None))

    def source(self) -> Node:
        if self.op("("):
            out = self.show_columns() if self.take("SHOW", "COLUMNS") else self.ordered_query()
            self.need_op(")")
            out = node("derived", query=out)
        else:
            out = node("table", path=self.path())
        alias = None
        if self.take("AS"):
            alias = self.name()
        elif self.tok.kind in ("name", "quoted") and (self.tok.kind == "quoted" or self.tok.text.upper() not in _STOP):
            alias = self.name()
        out.args["alias"] = alias
        return out

    # Predicates.

    def disjunction(self) -> Node:
        parts = [self.conjunction()]
        while self.take("OR") or self.op("||", "|"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else node("or", parts=parts)

    def conjunction(self) -> Node:
        parts = [self.predicate()]
        while self.take("AND") or self.op("&&", "&"):
            parts.append(self.predicate())
        return parts[0] if len(parts) == 1 else node("and", parts=parts)

    def predicate(self) -> Node:
        if self.word("NOT", "EXISTS") or self.word("EXISTS"):
            negated = self.take("NOT")
            self.need("EXISTS")
            return node("exists", query=self.subquery(), negated=negated)
        if self.take("NOT") or self.op("!"):
            return node("not", of=self.predicate())
        if self.tok.text == "(" and not self.word("SELECT", at=1):
            at = self.i
            try:
                self.need_op("(")
                out = self.disjunction()
                self.need_op(")")
                if not (self.tok.kind == "op" and (self.tok.text in "+-*/%" or self.tok.text.lstrip("&|") in _COMPARE)) and not self.word("IN") and not self.word("LIKE"):
                    return out
            except SqlError:
                pass
            self.i = at
        if self.word("TRUE") or self.word("FALSE"):
            if not (self.peek().kind == "op" and self.peek().text.lstrip("&|") in _COMPARE):
                return node("bool", value=self.name().upper() == "TRUE")
        left = self.expression()
        negated = self.take("NOT") or bool(self.op("!"))
        mode = None
        if self.tok.text in ("&", "|") and (self.word("LIKE", at=1) or self.word("IN", at=1) or self.word("NOT", "IN", at=1)):
            mode = self.op("&", "|")
            negated = negated or self.take("NOT")
        if self.take("LIKE"):
            return node("like", left=left, pattern=self.string(), negated=negated, mode=mode)
        if self.take("IN"):
            if self.tok.text == "(" and self.word("SELECT", at=1):
                return node("in_query", left=left, query=self.subquery(), negated=negated)
            self.need_op("(")
            values = [] if self.tok.text == ")" else self.listed(self.constant)
            self.need_op(")")
            return node("in", left=left, values=values, negated=negated, mode=mode)
        if self.tok.kind == "op" and self.tok.text.lstrip("&|") in _COMPARE:
            raw = self.tok.text
            self.i += 1
            mode = raw[0] if raw[0] in "&|" else None
            op = _COMPARE[raw.lstrip("&|")]
            for words, which in ((("ALL",), "all"), (("ANY",), "any"), (("SOME",), "any")):
                if self.take(*words):
                    return node("quantified", left=left, op=op, which=which, query=self.subquery())
            return node("compare", left=left, op=op, right=self.expression(), mode=mode)
        self.fail("a predicate")

    def subquery(self) -> Node:
        self.need_op("(")
        out = self.ordered_query()
        self.need_op(")")
        return out

    # Expressions.

    def expression(self) -> Node:
        left = self.term()
        while op := self.op("+", "-"):
            left = node("binary", op=op, left=left, right=self.term())
        return left

    def term(self) -> Node:
        left = self.unary()
        while self.tok.kind == "op" and self.tok.text in ("*", "/", "%"):
            op = self.op("*", "/", "%")
            left = node("binary", op=op, left=left, right=self.unary())
        return left

    def unary(self) -> Node:
        if self.op("-"):
            of = self.unary()
            return node("const", value=-of.value) if of.kind == "const" and isinstance(of.value, (int, float)) else node("negate", of=of)
        if self.op("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> Node:
        t = self.tok
        if t.kind == "op" and t.text == "(":
            if self.word("SELECT", at=1):
                return node("scalar_query", query=self.subquery())
            self.need_op("(")
            out = self.expression()
            self.need_op(")")
            return node("bracket", of=out)
        if t.kind in ("number", "string", "date") or (t.kind == "name" and t.text.upper() in ("TRUE", "FALSE", "NULL") and self.peek().text != "."):
            return node("const", value=self.constant())
        if self.word("CASE"):
            return self.case()
        if t.kind == "name" and self.peek().text == "(":
            return self.function()
        return node("path", path=self.path())

    def constant(self):
        t = self.tok
        if t.kind == "date":
            return self.time()
        if self.op("-"):
            return -self.constant()
        self.i += 1
        if t.kind == "string":
            return t.text
        if t.kind == "number":
            return int(t.text) if t.text.isdigit() else float(t.text)
        if t.kind == "name" and t.text.upper() in ("TRUE", "FALSE", "NULL", "NAN"):
            return {"TRUE": True, "FALSE": False, "NULL": None, "NAN": float("nan")}[t.text.upper()]
        self.i -= 1
        self.fail("a constant")

    def function(self) -> Node:
        name = self.name()
        self.need_op("(")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        args, named = [], {}
        while self.tok.text != ")" or self.tok.kind != "op":
            if self.tok.kind == "name" and self.peek().text == "=" and self.peek().kind == "op":
                key = self.name()
                self.need_op("=")
                named[key] = self.constant()
            else:
                args.append(self.expression())
            if not self.op(","):
                break
        self.need_op(")")
        return node("call", name=name, args_=args, named=named, distinct=distinct)

    def case(self) -> Node:
        start = self.i
        self.need("CASE")
        simple = None if self.word("WHEN") else self.expression()
        branches = []
        while self.take("WHEN"):
            if simple is None:
                condition = self.disjunction()
            else:
                negated = self.take("NOT") or bool(self.op("!"))
                if self.take("LIKE"):
                    condition = node("like", left=simple, pattern=self.string(), negated=negated, mode=None)
                else:
                    op = "="
                    if self.tok.kind == "op" and self.tok.text in _COMPARE:
                        op = _COMPARE[self.op(*_COMPARE)]
                    condition = node("compare", left=simple, op=op, right=self.expression(), mode=None)
            self.need("THEN")
            branches.append((condition, self.expression()))
        otherwise = self.expression() if self.take("ELSE") else None
        self.need("END")
        # Its own text names it, as set functions over different cases must not share a column.
        text = " ".join(f"'{t.text}'" if t.kind == "string" else t.text for t in self.toks[start : self.i])
        return node("case", branches=branches, otherwise=otherwise, text=text)


def parse(sql: str) -> Node:
    return Parser(sql).statement()
