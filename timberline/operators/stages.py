"""Parser stages: labels read out of the line at query time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text_udfs import json_labels, logfmt_labels, sanitize
from timberline.functions.values import QueryError, Regex
from timberline.operators.predicates import Scope

ERROR, SUFFIX = "__error__", "_extracted"


def literal_regex(text: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in text)


class PatternStage:
    """`pattern`: literals and captures; a capture runs to the first place of the next literal, or takes the rest."""

    def __init__(self, expr: str):
        self.expr, self.nodes = expr, []  # (is a capture, text)
        at = 0
        for m in re.finditer(r"<([A-Za-z_][A-Za-z0-9_]*)>", expr):
            if m.start() > at:
                self.nodes.append((False, expr[at : m.start()]))
            self.nodes.append((True, m[1]))
            at = m.end()
        if at < len(expr):
            self.nodes.append((False, expr[at:]))
        for a, b in zip(self.nodes, self.nodes[1:], strict=False):
            if a[0] and b[0]:
                raise QueryError(f"in pattern {expr!r} no text tells where <{a[1]}> ends and <{b[1]}> begins")
        self.names = [n for capture, n in self.nodes if capture and n != "_"]
        if len(set(self.names)) < len(self.names):
            raise QueryError(f"in pattern {expr!r} one name stands for two values")
        if not self.names:
            raise QueryError(f"pattern {expr!r} names nothing to read")

    may_fail = False

    def produces(self, name: str) -> bool:
        return name in self.names

    def struct(self, line: Column) -> Column:
        """One regular expression: each literal is optional only by the line's end, so a capture ends at its first place."""
        nodes, head = list(self.nodes), ""
        if not nodes[0][0]:
            head = literal_regex(nodes.pop(0)[1])
        pieces, groups, group, before = [], {}, 0, None
        for capture, text in nodes:
            group += 1
            if capture:
                groups[text] = (group, before)
                pieces.append("(.*?)")
            else:
                before = (group, text)
                pieces.append(f"(?:({literal_regex(text)})")
        closing = "".join(r"|\z)" for capture, _ in nodes if not capture)
        java = r"(?s)\A" + head + "".join(pieces) + (r"\z" if nodes[-1][0] else "") + closing
        hit = (F.length(line) > 0) & line.rlike(java)
        out = []
        for name in self.names:
            i, before = groups[name]
            taken = hit if before is None else hit & (F.regexp_extract(line, java, before[0]) == before[1])
            out.append(F.when(taken, F.regexp_extract(line, java, i)).alias(name))
        return F.struct(*out)


class RegexpStage:
    """`regexp`: the named groups of the leftmost match; a group that takes no part is empty."""

    may_fail = False

    def __init__(self, expr: str):
        self.expr, self.regex = expr, Regex(expr)
        if not self.regex.names:
            raise QueryError(f"regexp {expr!r}: at least one named group is required")
        self.groups: dict[str, int] = {}
        for i, name in self.regex.names.items():
            clean = sanitize(name)
            if clean in self.groups:
                raise QueryError(f"regexp {expr!r}: duplicate group name {clean}")
            self.groups[clean] = i
        self.names = list(self.groups)

    def produces(self, name: str) -> bool:
        return name in self.groups

    def struct(self, line: Column) -> Column:
        hit = line.rlike(self.regex.java)
        return F.struct(*[F.when(hit, F.regexp_extract(line, self.regex.java, i)).alias(n) for n, i in self.groups.items()])


class LogfmtStage:
    may_fail, names = False, None

    def produces(self, name: str) -> bool:
        return True


class JsonStage:
    may_fail, names = True, None

    def produces(self, name: str) -> bool:
        return True


@dataclass
class DropError:
    """`drop __error__`: removes the error if its value satisfies op and value (no op: any)."""

    op: str | None = None
    value: str = ""

    def __post_init__(self):
        self.regex = Regex(self.value) if self.op in ("=~", "!~") else None

    def drops(self, error: Column) -> Column:
        if self.op is None:
            return F.lit(True)
        if self.regex:
            c = error.rlike(self.regex.anchored)
            return c if self.op == "=~" else ~c
        return (error == self.value) if self.op == "=" else (error != self.value)


@dataclass
class Program:
    """The stages of a query in order. `extend` reads them once per row into columns __s<i>; all else refers to those."""

    steps: list = field(default_factory=list)

    def parses(self, n: int | None = None) -> bool:
        return any(not isinstance(s, DropError) for s in self.steps[:n])

    def may_produce(self, n: int, name: str) -> bool:
        """Whether a stage before the n-th may set a label of this name."""
        if name == ERROR:
            return any(not isinstance(s, DropError) and s.may_fail for s in self.steps[:n])
        plain = name.removesuffix(SUFFIX)
        return any(not isinstance(s, DropError) and (s.produces(name) or plain != name and s.produces(plain)) for s in self.steps[:n])

    def extend(self, logs: DataFrame) -> DataFrame:
        for i, s in enumerate(self.steps):
            if isinstance(s, (PatternStage, RegexpStage)):
                logs = logs.withColumn(f"__s{i}", s.struct(F.col("line")))
            elif isinstance(s, LogfmtStage):
                logs = logs.withColumn(f"__s{i}", logfmt_labels("line"))
            elif isinstance(s, JsonStage):
                logs = logs.withColumn(f"__s{i}", json_labels("line"))
        return logs

    def _raw(self, i: int, name: str) -> Column | None:
        s = self.steps[i]
        if isinstance(s, DropError) or not s.produces(name):
            return None
        if isinstance(s, JsonStage):
            return F.col(f"__s{i}")["labels"][name]
        return F.col(f"__s{i}")[name]

    def error(self, n: int | None = None) -> Column:
        """The error after the stages before the n-th, null if none."""
        out = F.lit(None).cast("string")
        for i, s in enumerate(self.steps[:n]):
            if isinstance(s, DropError):
                out = F.when(~s.drops(out), out)
            elif s.may_fail:
                out = F.coalesce(F.col(f"__s{i}")["error"], out)
        return out

    def value(self, scope: Scope, n: int, name: str) -> Column:
        """A label's value before the n-th stage: the error, a label of the row, what a stage read, or null."""
        if name == ERROR:
            return self.error(n)
        own, found = scope.own_label(name), []
        plain = name.removesuffix(SUFFIX)
        for i in range(min(n, len(self.steps))):
            direct = self._raw(i, name)
            if direct is not None:
                found.append(direct)  # a row's own label of this name has been taken before
            if plain and plain != name:
                clash = self._raw(i, plain)
                if clash is not None:
                    found.append(F.when(scope.own_label(plain).isNotNull(), clash))
        fallback = F.nullif(scope.label(name), F.lit("")) if name in ("level", "service") else F.lit(None).cast("string")
        return F.coalesce(own, *found, fallback)

    def labels(self, logs: DataFrame) -> Column:
        """All labels of a row's result: its own, those read (a clash gets a suffix, empty ones are left out), the error."""
        own, read = F.col("labels"), []
        for i, s in enumerate(self.steps):
            if isinstance(s, DropError):
                continue
            if s.names is None:
                m = F.col(f"__s{i}")["labels"] if isinstance(s, JsonStage) else F.col(f"__s{i}")
                read.append(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
            else:
                read.append(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"__s{i}")[n].alias("value")) for n in s.names]))
        if not read:
            return own
        pairs = F.filter(F.concat(*read), lambda p: p["value"].isNotNull())
        named = F.transform(pairs, lambda p: F.struct(F.when(F.map_contains_key(own, p["key"]), F.concat(p["key"], F.lit(SUFFIX))).otherwise(p["key"]).alias("key"), p["value"].alias("value")))
        keys = F.array_distinct(F.transform(named, lambda p: p["key"]))
        firsts = F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(named, lambda p: p["key"] == k)[0]["value"].alias("value")))
        filled = F.filter(firsts, lambda p: p["value"] != "")
        error = self.error()
        with_error = F.concat(filled, F.when(error.isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(F.struct(F.lit(ERROR).alias("key"), error.alias("value")))))
        kept = F.map_filter(own, lambda k, _: ~F.exists(with_error, lambda p: p["key"] == k))
        return F.map_concat(kept, F.map_from_entries(with_error))
