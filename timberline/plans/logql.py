"""Lexer and parser of the query language. What is not supported is refused with an error, never passed over."""

from __future__ import annotations

import re

from timberline.functions.values import QueryError
from timberline.operators.metric import RANGE_OPS, VECTOR_OPS
from timberline.plans.ast import LabelFilter, Labels, LineFilter, LogExpr, Matcher, MetricExpr, Parser, Unwrap

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
    | (?P<string>"(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' | `[^`]*`)
    | (?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[A-Za-zµμ]*(?:[0-9]+[A-Za-zµμ]+)*)
    | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
    | (?P<sign>\|=|\|~|!=|!~|=~|==|>=|<=|[|{}()\[\],=><+\-*/%^@:])""",
    re.X,
)
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:([abfnrtv\\'\"])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.?))", re.S)
_UNSUPPORTED = ("line_format", "label_format", "unpack", "decolorize", "distinct")


def unquote(raw: str) -> str:
    """The text of a string token."""
    quote, body = raw[0], raw[1:-1]
    if quote == "`":
        return body.replace("\r", "")
    out, at, data = bytearray(), 0, body
    for m in _ESCAPE.finditer(data):
        out += data[at : m.start()].encode("utf-8", "surrogatepass")
        at = m.end()
        named, x, u, wide, octal, _ = m.groups()
        if named and (named in _ESCAPES or named == quote):
            out += (_ESCAPES.get(named) or named).encode()
        elif x or octal:
            n = int(x, 16) if x else int(octal, 8)
            if n > 255:
                raise QueryError(f"invalid escape in {raw}")
            out.append(n)
        elif u or wide:
            n = int(u or wide, 16)
            if n > 0x10FFFF or 0xD800 <= n < 0xE000:
                raise QueryError(f"invalid escape in {raw}")
            out += chr(n).encode()
        else:
            raise QueryError(f"invalid escape in {raw}")
    out += data[at:].encode("utf-8", "surrogatepass")
    return out.decode("utf-8", "replace")


class _Tokens:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m[0], at))
            at = m.end()
        self.items.append(("end", "", len(text)))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.items[min(self.at + ahead, len(self.items) - 1)]

    def next(self) -> tuple[str, str, int]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, text: str) -> bool:
        if self.peek()[0] == "sign" and self.peek()[1] == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def word(self, what: str = "a name") -> str:
        kind, text, _ = self.peek()
        if kind != "name":
            self.fail(f"expected {what}")
        self.at += 1
        return text

    def string(self) -> str:
        kind, text, _ = self.peek()
        if kind != "string":
            self.fail("expected a string")
        self.at += 1
        return unquote(text)

    def fail(self, why: str):
        kind, text, at = self.peek()
        raise QueryError(f"{why}, found {text or kind!r} at {at}")


def parse(text: str) -> LogExpr | MetricExpr:
    """A log or metric query."""
    t = _Tokens(text)
    out = _log(t) if t.peek()[1] == "{" else _metric(t)
    if t.peek()[0] != "end":
        t.fail("unexpected text after the query")
    if isinstance(out, MetricExpr):
        out.source = text.strip()
    return out


def _log(t: _Tokens) -> LogExpr:
    t.need("{")
    out = LogExpr()
    while not t.take("}"):
        if out.matchers:
            t.need(",")
        label = t.word("a label")
        op = t.next()[1]
        if op not in ("=", "!=", "=~", "!~"):
            t.at -= 1
            t.fail("expected =, !=, =~ or !~")
        out.matchers.append(Matcher(label, op, t.string()))
    while (stage := _stage(t)) is not None:
        out.stages += stage
    return out


def _stage(t: _Tokens) -> list | None:
    kind, text, _ = t.peek()
    if kind == "sign" and text in ("|=", "|~", "!=", "!~"):
        t.next()
        return [LineFilter(text, t.string())]
    if not t.take("|"):
        return None
    name = t.word("a stage or a label")
    op = t.peek()
    if op[0] == "sign" and op[1] in ("=", "==", "!=", "=~", "!~", ">", ">=", "<", "<="):
        return _filters(t, name)
    if name in ("pattern", "regexp"):
        return [Parser(name, t.string())]
    if name in ("json", "logfmt"):
        if t.peek()[0] in ("name", "string") or t.peek()[1] in ("-", "--"):
            t.fail(f"{name} takes no parameters here")
        return [Parser(name)]
    if name == "unwrap":
        label = t.word("a label")
        if t.peek()[1] == "(":
            t.fail("conversions in unwrap are not supported")
        return [Unwrap(label)]
    if name in ("drop", "keep"):
        items = []
        while True:
            label, op = t.word("a label"), None
            if t.peek()[1] in ("=", "!=", "=~", "!~"):
                op = t.next()[1]
            items.append(Matcher(label, op, t.string() if op else ""))
            if not t.take(","):
                return [Labels(name == "keep", items)]
    if name in _UNSUPPORTED:
        raise QueryError(f"| {name} is not supported")
    t.fail(f"unknown stage {name!r}")


def _filters(t: _Tokens, label: str) -> list[LabelFilter]:
    out = []
    while True:
        op = t.next()[1]
        op = "=" if op == "==" else op
        kind, text, _ = t.peek()
        if kind == "string":
            if op in (">", ">=", "<", "<="):
                pass  # the bound may be written as a string
            out.append(LabelFilter(label, op, t.string()))
        elif kind == "number":
            if op in ("=~", "!~"):
                t.fail("expected a string")
            if not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text):
                t.fail("durations and sizes are not supported in label filters")
            t.next()
            out.append(LabelFilter(label, op, text, True))
        else:
            t.fail("expected a string or a number")
        kind, text, _ = t.peek()
        if kind == "name" and text == "or":
            t.fail("`or` between label filters is not supported")
        if kind == "name" and text == "and" or t.peek()[1] == ",":
            t.next()
            label = t.word("a label")
            if t.peek()[1] not in ("=", "==", "!=", "=~", "!~", ">", ">=", "<", "<="):
                t.fail("expected a comparison")
            continue
        return out


def _grouping(t: _Tokens) -> tuple[list[str], bool] | None:
    kind, text, _ = t.peek()
    if kind != "name" or text not in ("by", "without"):
        return None
    t.next()
    t.need("(")
    names: list[str] = []
    while not t.take(")"):
        if names:
            t.need(",")
        names.append(t.word("a label"))
    return names, text == "without"


def _metric(t: _Tokens) -> MetricExpr:
    name = t.word("a query")
    if name in RANGE_OPS:
        out = _range(t, name)
    elif name in VECTOR_OPS:
        before = _grouping(t)
        t.need("(")
        inner = t.word("a range aggregation")
        if inner not in RANGE_OPS:
            raise QueryError(f"{inner} is not supported inside {name}")
        out = _range(t, inner)
        t.need(")")
        after = _grouping(t)
        if before and before[0] and after:
            raise QueryError("grouping twice")
        # Grouping by nothing, either way, is no grouping: one series.
        names, without = after or before or ([], False)
        out.vector, out.grouping, out.without = name, names or None, without and bool(names)
    else:
        raise QueryError(f"{name} is not supported")
    return out


def _range(t: _Tokens, op: str) -> MetricExpr:
    t.need("(")
    log = _log(t)
    t.need("[")
    kind, text, _ = t.next()
    if kind != "number":
        t.at -= 1
        t.fail("expected a duration")
    t.need("]")
    if t.peek()[0] == "name":
        t.fail("modifiers are not supported")
    t.need(")")
    return MetricExpr(op, log, text)


def format_query(text: str) -> str:
    """The canonical print of a log query; a metric query as it is."""
    return str(parse(text))
