"""Predicates on log rows, each a Column. An absent label is the empty string."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.values import MAX_INT64, QueryError, Regex, float_of, level_name, read_float
from timberline.operators.templates import Templates

ORDERED = (">", ">=", "<", "<=")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


@dataclass
class Scope:
    """What predicates are compiled against: a DataFrame of logs and the declared templates."""

    logs: DataFrame
    templates: Templates = field(default_factory=Templates)
    materialized: bool = True  # False: typed fields are read from the line again, the differential form

    @property
    def columns(self) -> set[str]:
        return set(self.logs.columns)

    def own_label(self, key: str) -> Column:
        if self.materialized and f"lbl_{key}" in self.columns:
            return F.col(f"lbl_{key}")
        return F.col("labels")[key] if "labels" in self.columns else F.lit(None).cast("string")

    def label(self, key: str) -> Column:
        """A row's own label; level and service stand in for labels of their name."""
        out = [self.own_label(key)]
        if key == "level" and "level" in self.columns:
            out.append(level_name(F.col("level")))
        if key == "service" and "service" in self.columns:
            out.append(F.col("service"))
        return F.coalesce(*out, F.lit(""))

    def typed(self, name: str) -> tuple[Column, Column, Column]:
        """A field's values, the smallest and the largest."""
        if self.materialized and self.templates.current(self.logs, name):
            return F.col(f"f_{name}"), F.col(f"f_{name}__min"), F.col(f"f_{name}__max")
        values = self.templates.field(name, F.col("line"))
        return values, F.array_min(values), F.array_max(values)


def compare(left: Column, op: str, right) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


class Predicate:
    def column(self, scope: Scope) -> Column:
        raise NotImplementedError


@dataclass
class LineContains(Predicate):
    text: str
    negate: bool = False

    def column(self, scope: Scope) -> Column:
        if scope.materialized and self.text in scope.templates.literals:
            name = f"lit_{scope.templates.literals.index(self.text)}"
            if name in scope.columns and scope.logs.schema[name].metadata.get("pattern") == self.text:
                return ~F.col(name) if self.negate else F.col(name)
        c = F.contains("line", F.lit(self.text))
        return ~c if self.negate else c


@dataclass
class LineRegex(Predicate):
    pattern: str
    negate: bool = False

    def __post_init__(self):
        self.regex = Regex(self.pattern)

    def column(self, scope: Scope) -> Column:
        c = F.col("line").rlike(self.regex.java)
        return ~c if self.negate else c


@dataclass
class LabelEqual(Predicate):
    key: str
    value: str
    negate: bool = False

    def column(self, scope: Scope) -> Column:
        if not self.negate and self.value and self.key not in ("level", "service"):
            return scope.own_label(self.key) == self.value  # as it stands, this is pushed down
        return compare(scope.label(self.key), "!=" if self.negate else "=", self.value)


@dataclass
class LabelRegex(Predicate):
    key: str
    pattern: str
    negate: bool = False

    def __post_init__(self):
        self.regex = Regex(self.pattern)

    def column(self, scope: Scope) -> Column:
        c = scope.label(self.key).rlike(self.regex.anchored)
        return ~c if self.negate else c


@dataclass
class LabelCompare(Predicate):
    """Ordered comparison of a plain label: false unless both sides are floats; with a NaN they count as equal."""

    key: str
    op: str
    value: str

    def column(self, scope: Scope) -> Column:
        bound = read_float(self.value)
        if bound is None:
            return F.lit(False)
        v = float_of(scope.label(self.key))
        if math.isnan(bound):
            return v.isNotNull() & F.lit(self.op in (">=", "<="))
        return F.coalesce(F.when(F.isnan(v), F.lit(self.op in (">=", "<="))).otherwise(compare(v, self.op, F.lit(bound))), F.lit(False))


@dataclass
class TypedCompare(Predicate):
    """Comparison of a template's field: some value of the line must satisfy it; != holds without a value, too."""

    field: str
    op: str
    value: object

    def check(self, templates: Templates) -> None:
        if self.field not in templates.fields:
            raise QueryError(f"{self.field} is no field of a template")
        kind = templates.fields[self.field][1].kind
        right = {"int": int, "float": float}.get(kind, str)
        if not isinstance(self.value, right) or isinstance(self.value, bool):
            raise QueryError(f"{self.value!r} is not of the field's type, {kind}")
        if kind == "float" and not math.isfinite(self.value):
            raise QueryError("a bound must be finite")

    def column(self, scope: Scope) -> Column:
        self.check(scope.templates)
        values, low, high = scope.typed(self.field)
        kind = scope.templates.fields[self.field][1].kind
        bound = F.lit(self.value + 0.0 if kind == "float" else self.value)
        if self.op == "=":
            return (low <= bound) & (high >= bound) & F.array_contains(values, bound)
        if self.op == "!=":
            return low.isNull() | (low != bound) | (high != bound)
        return compare(low if self.op in ("<", "<=") else high, self.op, bound)


def typed_value(text: str, kind: str) -> object:
    """A bound as the query gives it, as a value of the field's type."""
    if kind == "int":
        if not re.fullmatch(r"[+-]?[0-9]+", text) or not -MAX_INT64 - 1 <= int(text) <= MAX_INT64:
            raise QueryError(f"{text!r} is not an int")
        return int(text)
    if kind == "float":
        v = read_float(text)
        if v is None or not math.isfinite(v):
            raise QueryError(f"{text!r} is not a finite float")
        return v
    if kind == "uuid":
        if not _UUID.fullmatch(text):
            raise QueryError(f"{text!r} is not a uuid")
        return text.lower()
    return text


@dataclass
class DynamicCompare(Predicate):
    """Comparison of a value read while the query runs (null: missing). kind: numeric, string or regex."""

    name: str
    extract: Callable[[Scope], Column]
    op: str
    value: str
    kind: str = "string"

    def __post_init__(self):
        if self.extract is None:
            raise QueryError(f"{self.name}: nothing to compare")
        if self.kind == "regex":
            if self.op not in ("=", "!="):
                raise QueryError(f"{self.op} with a regular expression")
            self.regex = Regex(self.value)
        if self.kind == "numeric":
            self.bound = read_float(self.value)
            if self.bound is None or not math.isfinite(self.bound):
                raise QueryError(f"{self.name}: {self.value!r} is not a finite number")

    def column(self, scope: Scope) -> Column:
        v = self.extract(scope)
        if self.kind == "numeric":  # missing or no number: false, != included; NaN satisfies != only
            n = float_of(v)
            return F.coalesce(F.when(F.isnan(n), F.lit(self.op == "!=")).otherwise(compare(n, self.op, F.lit(self.bound))), F.lit(False))
        v = F.coalesce(v, F.lit(""))
        if self.kind == "regex":
            c = v.rlike(self.regex.anchored)
            return ~c if self.op == "!=" else c
        return compare(v, self.op, self.value)


@dataclass
class Custom(Predicate):
    """Any predicate: a function of the scope that gives a Column."""

    make: Callable[[Scope], Column]

    def column(self, scope: Scope) -> Column:
        return self.make(scope)


def all_of(predicates: list[Predicate], scope: Scope) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & F.coalesce(p.column(scope), F.lit(False)) if not isinstance(p, (LineContains, LabelEqual, TypedCompare)) else out & p.column(scope)
    return out
