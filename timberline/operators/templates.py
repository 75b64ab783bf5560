"""Templates: typed values in the text of a line, read by declared patterns such as `took {ms:int}ms`.

Every occurrence of a template's first literal is tried, overlapping ones too; an occurrence counts if all its
literals and captures fit. A field is the array of its values in the order of occurrence, with its smallest and
largest beside it: for a comparison some value must satisfy, those two decide, and they are pushed down to Parquet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.values import QueryError

ANCHOR = 3
SPARK_TYPE = {"int": "bigint", "float": "double", "str": "string", "uuid": "string"}
_SHAPE = {
    "int": r"([+-]?[0-9]++)",
    "float": r"([+-]?[0-9]++(?:\.[0-9]*+)?+(?:[eE][+-]?[0-9]++)?+)",
    "uuid": r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})",
}


def _quoted(text: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in text)


@dataclass(frozen=True)
class Capture:
    name: str
    kind: str
    field: str


#: Characters that a value of a kind may hold. Text behind a capture that begins with one could be read as its rest.
VALUE_CHARS = {"int": "+-0123456789", "float": "+-.eE0123456789", "uuid": "-0123456789abcdefABCDEF", "str": ""}


def _read(name: str, pattern: str) -> tuple[list, list[str]]:
    """The parts of a pattern, texts and captures in turn, and what of it is no capture though it has a brace."""
    parts: list[str | Capture] = []
    wrong: list[str] = []
    for text, brace in re.findall(r"([^{]+)|(\{[^}]*\}?)", pattern):
        label, colon, kind = brace[1:-1].partition(":")
        if text:
            parts.append(text)
        elif not brace.endswith("}"):
            wrong.append(f"{brace} has no closing brace")
        elif not (label and colon and kind):
            wrong.append(f"{brace} is not a name, a colon and a type")
        elif kind not in SPARK_TYPE:
            wrong.append(f"{brace} is none of the types {', '.join(SPARK_TYPE)}")
        else:
            parts.append(Capture(label, kind, f"{name}_{label}"))
    return parts, wrong


def _faults(parts: list) -> list[str]:
    """Why lines could not be searched for these parts, or a value's end would be in doubt."""
    texts = [p for p in parts if isinstance(p, str)]
    labels = [p.name for p in parts if isinstance(p, Capture)]
    out = []
    if max((len(t.encode()) for t in texts), default=0) < ANCHOR:
        out.append(f"lines are searched for a text of {ANCHOR} bytes or more, and it has none")
    if parts and not isinstance(parts[0], str):
        out.append("the search begins with its first text, so a capture cannot come before")
    for label in sorted({x for x in labels if labels.count(x) > 1}):
        out.append(f"{label} stands for two values")
    for p, behind in zip(parts, parts[1:], strict=False):
        if isinstance(p, str):
            continue
        if not isinstance(behind, str):
            out.append(f"no text tells where {p.name} ends and {behind.name} begins")
        elif p.kind in ("int", "float") and behind[0] in VALUE_CHARS[p.kind].replace("+", "").replace("-", ""):
            out.append(f"{behind[0]!r} may be part of {p.name} or of the text behind it")
    return out


class Template:
    def __init__(self, name: str, pattern: str):
        self.name, self.pattern = name, pattern
        self.parts, wrong = _read(name, pattern)
        wrong = wrong or _faults(self.parts)
        if not name:
            wrong.append("it has no name")
        if wrong:
            raise QueryError(f"template {name!r} cannot be used: {'; '.join(wrong)}")

    @property
    def captures(self) -> list[Capture]:
        return [p for p in self.parts if isinstance(p, Capture)]

    @property
    def as_pattern(self) -> tuple:
        """What a `pattern` stage between two <_> must say to read the same values: (is a name, text) of each part."""
        return tuple((isinstance(p, Capture), p.field if isinstance(p, Capture) else p) for p in self.parts)

    @property
    def ends_alike(self) -> bool:
        """Whether each value ends where the text behind it first comes, which is where a `pattern` ends it."""
        return not any(isinstance(p, Capture) and behind[0] in VALUE_CHARS[p.kind] for p, behind in zip(self.parts, self.parts[1:], strict=False))

    @property
    def shape(self) -> tuple:
        return tuple(p if isinstance(p, str) else (p.kind,) for p in self.parts)

    @property
    def regex(self) -> str:
        out = []
        for i, p in enumerate(self.parts):
            if isinstance(p, str):
                out.append(_quoted(p))
            elif p.kind == "str":
                stop = f"(?!{_quoted(self.parts[i + 1])})" if i + 1 < len(self.parts) else ""
                out.append(rf'((?:{stop}[^ \t\n\r",}}\]]){{1,256}}+)')
            else:
                out.append(_SHAPE[p.kind])
        return "".join(out)

    def _typed(self, text: Column, kind: str) -> Column:
        if kind == "int":
            return text.try_cast("bigint")
        if kind == "float":
            v = text.try_cast("double")
            return F.when(F.abs(v) < float("inf"), F.when(v == 0, F.lit(0.0)).otherwise(v))
        return F.lower(text) if kind == "uuid" else F.when(F.octet_length(text) <= 256, text)

    def occurrences(self, line: Column) -> Column:
        """Array of structs, a field each, of the occurrences that fit."""
        ahead = F.lit(f"(?=(?d){self.regex})")
        found = [F.regexp_extract_all(line, ahead, F.lit(i + 1)) for i in range(len(self.captures))]
        if not found:
            return F.transform(F.regexp_extract_all(line, F.lit(f"(?=({self.regex}))"), F.lit(1)), lambda x: F.struct(x.alias("_")))
        zipped = F.arrays_zip(*[f.alias(c.field) for f, c in zip(found, self.captures, strict=True)])
        typed = F.transform(
            zipped, lambda x: F.struct(*[self._typed(x[c.field], c.kind).alias(c.field) for c in self.captures])
        )

        def whole(x: Column) -> Column:
            ok = F.lit(True)
            for c in self.captures:
                ok = ok & x[c.field].isNotNull()
            return ok

        return F.when(F.contains(line, F.lit(self.parts[0])), F.filter(typed, whole))

    def tried(self, line: Column) -> Column:
        """How often the first literal occurs."""
        return F.size(F.regexp_extract_all(line, F.lit(f"(?=({_quoted(self.parts[0])}))"), F.lit(1)))


class Templates:
    """The declared templates, and literals whose presence in a line is a column of its own."""

    def __init__(self, patterns: dict[str, str] | None = None, literals: tuple[str, ...] = (), label_keys: tuple[str, ...] = ()):
        self.templates = [Template(n, p) for n, p in (patterns or {}).items()]
        self.literals, self.label_keys = tuple(literals), tuple(label_keys)
        self.fields: dict[str, tuple[Template, Capture]] = {}
        shapes: dict[tuple, str] = {}
        for t in self.templates:
            if t.shape in shapes:
                raise QueryError(f"templates {shapes[t.shape]!r} and {t.name!r} would read the same values")
            shapes[t.shape] = t.name
            for c in t.captures:
                if c.field in self.fields:
                    raise QueryError(f"templates {self.fields[c.field][0].name!r} and {t.name!r} both give a field {c.field}")
                self.fields[c.field] = t, c
        if "" in self.literals or len(set(self.literals)) < len(self.literals):
            raise QueryError("each literal must have characters and be there once")

    def field(self, name: str, line: Column) -> Column:
        """Array of a field's values, null where it has none."""
        template, capture = self.fields[name]
        got = F.transform(template.occurrences(line), lambda x: x[capture.field])
        return F.when(F.size(got) > 0, got)

    def materialize(self, logs: DataFrame) -> DataFrame:
        """logs with f_<field>, its __min and __max, lbl_<key> and lit_<i>; each field's pattern is in its metadata."""
        # The occurrences of a template once, in a projection of their own, however many fields it has.
        found = {t.name: f"__o_{i}" for i, t in enumerate(self.templates) if t.captures}
        logs = logs.withColumns({found[t.name]: t.occurrences(F.col("line")) for t in self.templates if t.captures})
        for name, (t, c) in self.fields.items():
            logs = logs.withColumn(f"f_{name}", F.when(F.size(found[t.name]) > 0, F.col(found[t.name])[c.field]))
            for end, f in (("min", F.array_min), ("max", F.array_max)):
                logs = logs.withColumn(f"f_{name}__{end}", f(f"f_{name}")).withMetadata(f"f_{name}__{end}", {"pattern": t.pattern})
            logs = logs.withMetadata(f"f_{name}", {"pattern": t.pattern})
        for i, literal in enumerate(self.literals):
            logs = logs.withColumn(f"lit_{i}", F.contains("line", F.lit(literal))).withMetadata(f"lit_{i}", {"pattern": literal})
        for key in self.label_keys:
            logs = logs.withColumn(f"lbl_{key}", F.col("labels")[key])
        return logs.drop(*found.values())

    def current(self, logs: DataFrame, name: str) -> bool:
        """Whether logs holds this field as read by today's pattern; otherwise it is read from the line again."""
        column = f"f_{name}"
        return column in logs.columns and logs.schema[column].metadata.get("pattern") == self.fields[name][0].pattern

    def stats(self, logs: DataFrame) -> DataFrame:
        """template, candidates (first literal found), matches, failures over all lines."""
        columns = []
        for t in self.templates:
            columns += [F.sum(t.tried(F.col("line"))).alias(f"{t.name}__c"), F.sum(F.greatest(F.size(F.coalesce(t.occurrences(F.col("line")), F.array())), F.lit(0))).alias(f"{t.name}__m")]
        one = logs.agg(*columns)
        rows = F.array(*[F.struct(F.lit(t.name).alias("template"), F.coalesce(f"{t.name}__c", F.lit(0)).alias("candidates"), F.coalesce(f"{t.name}__m", F.lit(0)).alias("matches")) for t in self.templates])
        return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("failures", F.col("candidates") - F.col("matches"))
