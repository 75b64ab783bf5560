"""The query language's syntax tree and its canonical print."""

from __future__ import annotations

from dataclasses import dataclass, field

_NAMED = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}


def quoted(text: str) -> str:
    """A text in double quotes, with escapes."""
    out = []
    for c in text:
        if c in _NAMED:
            out.append(_NAMED[c])
        elif c.isprintable():
            out.append(c)
        else:
            n = ord(c)
            out.append(f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}")
    return '"' + "".join(out) + '"'


@dataclass
class Matcher:
    label: str
    op: str | None
    value: str = ""

    def __str__(self) -> str:
        return self.label if self.op is None else f"{self.label}{self.op}{quoted(self.value)}"


@dataclass
class LineFilter:
    op: str
    value: str

    def __str__(self) -> str:
        return f"{self.op} {quoted(self.value)}"


@dataclass
class Parser:
    name: str
    expr: str | None = None

    def __str__(self) -> str:
        return f"| {self.name}" + (f" {quoted(self.expr)}" if self.expr is not None else "")


@dataclass
class LabelFilter:
    label: str
    op: str
    value: str
    numeric: bool = False

    def __str__(self) -> str:
        return f"| {self.label} {self.op} {self.value if self.numeric else quoted(self.value)}"


@dataclass
class Unwrap:
    label: str

    def __str__(self) -> str:
        return f"| unwrap {self.label}"


@dataclass
class Labels:
    keep: bool
    items: list[Matcher]

    def __str__(self) -> str:
        return f"| {'keep' if self.keep else 'drop'} " + ", ".join(map(str, self.items))


@dataclass
class LogExpr:
    matchers: list[Matcher] = field(default_factory=list)
    stages: list = field(default_factory=list)

    def __str__(self) -> str:
        return " ".join(["{" + ",".join(map(str, self.matchers)) + "}", *map(str, self.stages)])


@dataclass
class MetricExpr:
    op: str
    log: LogExpr
    range: str
    vector: str | None = None
    grouping: list[str] | None = None
    without: bool = False
    source: str = ""

    @property
    def unwrap(self) -> str | None:
        last = [s.label for s in self.log.stages if isinstance(s, Unwrap)]
        return last[-1] if last else None

    def __str__(self) -> str:
        return self.source
