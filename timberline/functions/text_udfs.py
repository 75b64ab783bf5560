"""Labels read out of text: what built-in functions cannot do exactly, as Arrow-batched functions.

JSON keeps a number's own spelling, and what was read before an error; built-in JSON functions re-render numbers.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

ERROR = "JSONParserErr"
_LABELS = MapType(StringType(), StringType())
_NAME = re.compile(r"[^0-9A-Za-z_]")
_GO_SPACE = "\t\n\v\f\r \x85\xa0"
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_BLANK = re.compile(r"[ \t\n\r]*")


def sanitize(key: str) -> str:
    """A label name of any text: trimmed, no leading digit, no other signs than letters, digits and _."""
    key = key.strip()
    if key[:1].isascii() and key[:1].isdigit():
        key = "_" + key
    return _NAME.sub("_", key)


def json_name(path: list[str]) -> str:
    out = ""
    for part in path:
        part = part.strip()
        if part:
            out += "_" if out or part[0] in "0123456789" else ""
            out += _NAME.sub("_", part)
    return out


class _Broken(Exception):
    pass


class _Reader:
    """Reads one JSON object, giving its scalars as it goes."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise _Broken
        self.at += 1

    def string(self) -> str:
        if self.peek() != '"':
            raise _Broken
        try:
            value, self.at = json.decoder.scanstring(self.text, self.at + 1, True)
        except ValueError:
            raise _Broken from None
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def scalar(self):
        """(kind, value) of a string, number, boolean or null."""
        c = self.peek()
        if c == '"':
            return self.string()
        for word, value in (("true", "true"), ("false", "false"), ("null", None)):
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return value
        m = _NUMBER.match(self.text, self.at)
        if not m:
            raise _Broken
        self.at = m.end()
        return m[0]

    def items(self, close: str):
        """Steps over the commas of an array or object whose opening sign has been read."""
        if self.peek() == close:
            self.at += 1
            return
        while True:
            yield
            c = self.peek()
            self.at += 1
            if c == close:
                return
            if c != ",":
                raise _Broken

    def skip(self) -> None:
        c = self.peek()
        if c == "[":
            self.at += 1
            for _ in self.items("]"):
                self.skip()
        elif c == "{":
            self.at += 1
            for _ in self.items("}"):
                self.string()
                self.take(":")
                self.skip()
        else:
            self.scalar()

    def members(self, path: list[str], emit) -> None:
        self.take("{")
        for _ in self.items("}"):
            key = self.string()
            self.take(":")
            c = self.peek()
            if c == "{":
                self.members([*path, key], emit)
            elif c == "[":
                self.skip()
            else:
                value = self.scalar()
                if value is not None:
                    emit([*path, key], value)


def read_json(line: str | None) -> tuple[dict[str, str], str | None]:
    """Labels of a JSON object, first value of a name wins, and an error; nested names are joined with _."""
    out: dict[str, str] = {}

    def emit(path: list[str], value: str) -> None:
        name = json_name(path)
        if name:
            out.setdefault(name, value.replace("�", ""))

    try:
        _Reader(line or "").members([], emit)
    except (_Broken, RecursionError):
        return out, ERROR
    return out, None


def read_extra(text: str | None) -> dict[str, str]:
    """The scalars of a whole JSON object by key, last value wins; nothing if it isn't one."""
    out: dict[str, str] = {}
    reader = _Reader(text or "")
    try:
        reader.take("{")
        for _ in reader.items("}"):
            key = reader.string()
            reader.take(":")
            if reader.peek() in ("{", "["):
                reader.skip()
                out.pop(key, None)
            else:
                value = reader.scalar()
                out.pop(key, None)
                if value is not None:
                    out[key] = value
        if reader.peek():
            return {}
    except (_Broken, RecursionError):
        return {}
    return out


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_PAIR_END = re.compile(r"[\x00-\x20]")


def read_logfmt(line: str | None) -> dict[str, str]:
    """key=value pairs; a pair that does not read is left out, an empty value too, the first value of a key wins."""
    out: dict[str, str] = {}
    text, at = line or "", 0
    n = len(text)

    def blank(i: int) -> int:
        m = _PAIR_END.search(text, i)
        return m.start() if m else n

    while at < n:
        if text[at] <= " ":
            at += 1
            continue
        start = at
        while at < n and text[at] > " " and text[at] not in '="':
            at += 1
        key = text[start:at]
        if at < n and text[at] == '"' or at < n and text[at] == "=" and (not key or "�" in key):
            at = blank(at)
            continue
        if at >= n or text[at] != "=":
            continue  # a key alone
        at += 1
        if at < n and text[at] == '"':
            m = _QUOTED.match(text, at)
            if not m:
                break  # never closed
            at, value = m.end(), m[1]
            if "\\" in value:
                try:
                    value = json.loads(m[0])
                except ValueError:
                    continue
        else:
            end = at
            while end < n and text[end] > " " and text[end] not in '="':
                end += 1
            if end < n and text[end] > " ":
                at = blank(end)
                continue
            value, at = text[at:end], end
        name = sanitize(key)
        if name and value:
            out.setdefault(name, value.replace("�", ""))
    return out


@F.pandas_udf(_LABELS)
def extra_labels(text: pd.Series) -> pd.Series:
    return text.map(read_extra, na_action=None)


@F.pandas_udf(_LABELS)
def logfmt_labels(line: pd.Series) -> pd.Series:
    return line.map(read_logfmt, na_action=None)


@F.pandas_udf(StructType([StructField("labels", _LABELS), StructField("error", StringType())]))
def json_labels(line: pd.Series) -> pd.DataFrame:
    got = [read_json(x) for x in line]
    return pd.DataFrame({"labels": [g[0] for g in got], "error": [g[1] for g in got]})
