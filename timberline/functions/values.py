"""Values as text: durations, levels, numbers and regular expressions, as the query language means them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class QueryError(ValueError):
    """A query that cannot be parsed or is refused."""


# ---- durations

#: Nanoseconds of each unit. Fixed values.
UNITS = {
    "ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000,
    "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000, "y": 31_536_000_000_000_000,
}
MAX_INT64 = 2**63 - 1
_TERM = re.compile(r"([0-9.]*)([^0-9.]*)")


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as 5m, 1h30m or 1.5h; "0" is none. A sign, an unknown unit or overflow is an error."""
    if text == "0":
        return 0
    total, at = 0, 0
    if not text:
        raise QueryError("empty duration")
    while at < len(text):
        m = _TERM.match(text, at)
        number, unit = m[1], m[2]
        whole, _, fraction = number.partition(".")
        if unit not in UNITS or not (whole or fraction) or "." in fraction:
            raise QueryError(f"bad duration {text!r}")
        total += int(whole or 0) * UNITS[unit] + int(float(f"0.{fraction or 0}") * UNITS[unit])
        if total > MAX_INT64:
            raise QueryError(f"duration {text!r} overflows")
        at = m.end()
    return total


# ---- levels

#: Level names, lowest first, and what else is read as each. Fixed values.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
ALIASES = {
    "debug": 0, "trace": 0,
    "info": 1, "information": 1, "notice": 1,
    "warn": 2, "warning": 2,
    "error": 3, "err": 3, "fatal": 3, "critical": 3, "crit": 3, "panic": 3,
}


def level_of(text: Column) -> Column:
    """The level that a text names, null if none."""
    t = F.lower(F.trim(text))
    out = F.lit(None).cast("tinyint")
    for n in range(len(LEVELS)):
        out = F.when(t.isin([k for k, v in ALIASES.items() if v == n]), F.lit(n).cast("tinyint")).otherwise(out)
    return out


def level_name(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in enumerate(LEVELS):
        out = F.when(level == n, name).otherwise(out)
    return out


# ---- numbers

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_HEX = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z"


def float_of(text: Column) -> Column:
    """A text as a float: decimal or hexadecimal, in range, or spelled infinity or NaN; null if it is none."""
    number = text.try_cast("double")
    return (
        F.when(text.rlike(_DECIMAL) | text.rlike(_HEX), F.when(F.abs(number) < float("inf"), number))
        .when(text.rlike(r"^(?i)[+-]?inf(inity)?\z"), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(text.rlike(r"^(?i)nan\z"), float("nan"))
    )


def read_float(text: str) -> float | None:
    if re.fullmatch(_DECIMAL.replace(r"\z", ""), text) or re.fullmatch(r"(?i)[+-]?inf(inity)?|nan", text):
        v = float(text)
        return None if v in (float("inf"), float("-inf")) and text[-1:].isdigit() else v
    return float.fromhex(text) if re.fullmatch(_HEX.replace(r"\z", ""), text) else None


# ---- regular expressions

_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_SPACE, _WORD = r"\t\n\f\r ", "0-9A-Za-z_"
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")


class Regex:
    """An RE2 pattern in Java's terms: java, and the names of its groups by number. What RE2 refuses, or what cannot be
    said in Java with the same meaning, is refused."""

    def __init__(self, pattern: str):
        self.pattern, self.names = pattern, {}
        self._groups, self._multiline = 0, bool(re.search(r"\(\?[a-z]*m", pattern))
        try:
            pattern.encode()
        except UnicodeEncodeError as e:
            raise QueryError(f"invalid regular expression {pattern!r}") from e
        out, i, depth, repeatable = [], 0, 0, False
        while i < len(pattern):
            c = pattern[i]
            if c == "\\":
                piece, i = self._escape(i, False)
                out.append(piece)
                repeatable = True
            elif c == "[":
                piece, i = self._set(i)
                out.append(piece)
                repeatable = True
            elif c == "(":
                piece, i, opened = self._open(i)
                out.append(piece)
                depth += opened
                repeatable = False
            elif c == ")":
                depth -= 1
                if depth < 0:
                    self._bad("unexpected )")
                out.append(c)
                i, repeatable = i + 1, True
            elif c in "*+?" or (c == "{" and _REPEAT.match(pattern, i)):
                m = _REPEAT.match(pattern, i)
                if not repeatable:
                    self._bad("missing argument to repetition operator")
                if m and (int(m[1]) > 1000 or (m[3] and (int(m[3]) > 1000 or int(m[3]) < int(m[1])))):
                    self._bad("invalid repeat count")
                out.append(m[0] if m else c)
                i = m.end() if m else i + 1
                if pattern[i : i + 1] == "?":
                    out.append("?")
                    i += 1
                if pattern[i : i + 1] in ("*", "+", "?") or _REPEAT.match(pattern, i):
                    self._bad("invalid nested repetition operator")
                repeatable = False
            elif c == "$":
                out.append("$" if self._multiline else r"\z")
                i, repeatable = i + 1, True
            else:
                out.append("\\" + c if c in "{}]" else c)
                i, repeatable = i + 1, c not in "|"
        if depth:
            self._bad("missing closing )")
        self.java = "(?d)" + "".join(out)
        self.anchored = rf"(?d)\A(?:{''.join(out)})\z"

    def _bad(self, why: str):
        raise QueryError(f"invalid regular expression {self.pattern!r}: {why}")

    def _open(self, i: int) -> tuple[str, int, int]:
        p = self.pattern
        if p[i + 1 : i + 2] != "?":
            self._groups += 1
            return "(", i + 1, 1
        m = re.match(r"\(\?P?<([A-Za-z0-9_]+)>", p[i:])
        if m:
            if m[1] in self.names.values():
                self._bad(f"duplicate capture group name {m[1]}")
            self._groups += 1
            self.names[self._groups] = m[1]
            return "(", i + m.end(), 1
        m = re.match(r"\(\?([imsU]*)(-[imsU]+)?([:)])", p[i:])
        if not m or "U" in m[1] + (m[2] or ""):
            self._bad("unsupported group")
        on = m[1].replace("i", "iu")
        off = (m[2] or "").replace("i", "iu")
        return f"(?{on}{off}{m[3]}" if on or off or m[3] == ":" else "", i + m.end(), int(m[3] == ":")

    def _escape(self, i: int, inside: bool) -> tuple[str, int]:
        p = self.pattern
        if i + 1 >= len(p):
            self._bad("trailing backslash")
        c = p[i + 1]
        wrap = (lambda x: x) if inside else (lambda x: f"[{x}]")
        if c in "dDwW":
            return p[i : i + 2], i + 2
        if c == "s":
            return wrap(_SPACE), i + 2
        if c == "S":
            return ("[^" + _SPACE + "]"), i + 2
        if c in "pP":
            m = re.match(r"\\[pP](?:\{(\^?)([A-Za-z_]+)\}|([A-Za-z]))", p[i:])
            if not m:
                self._bad("invalid character class")
            name = m[2] or m[3]
            sign = "P" if (c == "P") != bool(m[1]) else "p"
            return f"\\{sign}{{{name if len(name) <= 2 else 'Is' + name}}}", i + m.end()
        if c == "x":
            m = re.match(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))", p[i:])
            if not m:
                self._bad("invalid escape")
            return f"\\x{{{m[1] or m[2]}}}", i + m.end()
        if c in "tnrfa":
            return p[i : i + 2], i + 2
        if c == "v":
            return r"\x0B", i + 2
        if c == "Q" and not inside:
            end = p.find("\\E", i)
            raw = p[i + 2 :] if end < 0 else p[i + 2 : end]
            return "".join("\\" + x if x in r"\.[]{}()*+-?^$|&#" else x for x in raw), len(p) if end < 0 else end + 2
        if not inside and c in "Az":
            return p[i : i + 2], i + 2
        if not inside and c == "b":
            return f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))", i + 2
        if not inside and c == "B":
            return f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))", i + 2
        if c.isascii() and not c.isalnum():
            return "\\" + c, i + 2
        self._bad(f"invalid escape \\{c}")

    def _set(self, i: int) -> tuple[str, int]:
        p, out = self.pattern, ["["]
        i += 1
        if p[i : i + 1] == "^":
            out.append("^")
            i += 1
        first = True
        while True:
            if i >= len(p):
                self._bad("missing closing ]")
            c = p[i]
            if c == "]" and not first:
                out.append("]")
                return "".join(out), i + 1
            first = False
            m = re.match(r"\[:(\^?)([a-z]+):\]", p[i:])
            if m:
                if m[2] not in _POSIX:
                    self._bad("invalid character class range")
                out.append(f"[{m[1]}{_POSIX[m[2]]}]")
                i += m.end()
            elif c == "\\":
                piece, i = self._escape(i, True)
                out.append(piece)
            else:
                out.append("\\" + c if c in "[]&^" else c)
                i += 1
