"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, date, duration, op, end
    text: str
    at: int


class SqlError(ValueError):
    pass


_RULES = [
    ("space", r"\s+|--[^\n]*|/\*.*?\*/"),
    ("date", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T]\d{1,2}:\d{2}:\d{2}(?:\.\d{1,9})?)?"),
    ("duration", r"\d+(?:mo|ms|us|ns|[ywdhms])\b(?:\d+(?:mo|ms|us|ns|[ywdhms])\b)*"),
    ("number", r"\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+"),
    ("string", r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\""),
    ("quoted", r"`(?:[^`]|``)+`"),
    ("name", r"[^\W\d][\w@#$]*"),
    ("op", r"&>=|&<=|&==|&!=|&<>|&>|&<|&=|\|>=|\|<=|\|==|\|!=|\|<>|\|>|\|<|\|=|<>|!=|==|>=|<=|&&|\|\||[-+*/%=<>(),.;\[\]&|!:]"),
]
_PATTERN = re.compile("|".join(f"(?P<{k}>{r})" for k, r in _RULES), re.DOTALL | re.IGNORECASE)
# What a backslash and a letter stand for in strings.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b"}


def unescape(body: str) -> str:
    return re.sub(r"\\(.)|''", lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        found = _PATTERN.match(sql, at)
        if not found:
            raise SqlError(f"can't read {sql[at : at + 20]!r} at {at}")
        kind, text = found.lastgroup, found[0]
        if kind == "string":
            out.append(Token("string", unescape(text[1:-1]), at))
        elif kind == "quoted":
            out.append(Token("quoted", text[1:-1].replace("``", "`"), at))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at = found.end()
    out.append(Token("end", "", at))
    return out
