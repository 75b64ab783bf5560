"""Pushes of log entries as JSON: each body is taken whole, or refused with a reason.

A body is one object. Its member `streams` (in any case, here only) lists streams: `stream`, labels of text, and
`values`, entries of [nanoseconds as text, line] or [nanoseconds, line, labels of the entry's own]. An entry's own labels
lie over its stream's.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

MOST_ENTRIES = 100_000
_ENTRY = StructType([StructField("ts_ns", LongType()), StructField("line", StringType()), StructField("labels", MapType(StringType(), StringType()))])
_PUSH = StructType([StructField("entries", ArrayType(_ENTRY)), StructField("error", StringType())])
_NANOSECONDS = re.compile(r"[+-]?[0-9]+")


class Refused(Exception):
    pass


def _want(value, kind: type, what: str):
    """The value if it is of a kind; an empty one for null."""
    if value is not None and not isinstance(value, kind):
        raise Refused(f"{what} is {json.dumps(value)[:60]}")
    return kind() if value is None else value


def _texts(value, what: str) -> dict[str, str]:
    return {k: _want(v, str, f"{what} {k}") for k, v in _want(value, dict, what).items()}


def _entry(value, own: dict[str, str]) -> tuple[int, str, dict[str, str]]:
    value = _want(value, list, "an entry")
    if len(value) < 2:
        raise Refused("an entry has no line")
    at = _want(value[0], str, "a time")
    if not _NANOSECONDS.fullmatch(at) or not -(2**63) <= int(at) < 2**63:
        raise Refused(f"{at[:40]!r} is not a time in nanoseconds")
    more = _texts(value[2], "metadata") if len(value) > 2 else {}
    return int(at), _want(value[1], str, "a line"), own | more


def read_push(body: str | None, most: int = MOST_ENTRIES) -> tuple[list[tuple[int, str, dict[str, str]]], str | None]:
    """The entries of a body, or why it is refused."""
    out: list[tuple[int, str, dict[str, str]]] = []
    try:
        members = _want(json.loads(body or "", object_pairs_hook=_Members), _Members, "a push")
        for name, streams in members.pairs:
            if name.lower() != "streams":
                continue
            for stream in _want(_plain(streams), list, "streams"):
                stream = _want(stream, dict, "a stream")
                own = _texts(stream.get("stream"), "label")
                for value in _want(stream.get("values"), list, "values"):
                    if len(out) >= most:
                        raise Refused(f"more than {most} entries")
                    out.append(_entry(value, own))
    except (ValueError, RecursionError) as e:
        return [], f"not JSON: {e}"[:200]
    except Refused as e:
        return [], str(e)
    return out, None


class _Members:
    """An object's members, one name as often as it stands there."""

    def __init__(self, pairs: list | None = None):
        self.pairs = pairs or []


def _plain(value):
    if isinstance(value, _Members):
        return {k: _plain(v) for k, v in value.pairs}
    return [_plain(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(_PUSH)
def _read(bodies: pd.Series) -> pd.DataFrame:
    rows = [read_push(b) for b in bodies]
    entries = [[{"ts_ns": t, "line": line, "labels": labels} for t, line, labels in found] for found, _ in rows]
    return pd.DataFrame({"entries": entries, "error": [e for _, e in rows]})


def read_pushes(bodies: DataFrame, column: str = "body") -> DataFrame:
    """bodies with a column push: entries (ts_ns, line, labels), or none and an error."""
    return bodies.withColumn("push", _read(F.col(column)))


def refused(pushes: DataFrame) -> DataFrame:
    """What read_pushes gave, of bodies that were refused: their columns and error."""
    return pushes.where("push.error is not null").withColumn("error", F.col("push.error")).drop("push")


def entries(pushes: DataFrame) -> DataFrame:
    """What read_pushes gave -> ts_ns, line, labels of all entries taken."""
    return pushes.select(F.explode("push.entries").alias("e")).select("e.ts_ns", "e.line", "e.labels")
