"""Log queries: a time window, predicates, and the first rows in a total order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.values import QueryError
from timberline.operators.predicates import Custom, DynamicCompare, Predicate, Scope, TypedCompare, all_of
from timberline.operators.stages import Program
from timberline.operators.templates import Templates

DEFAULT_LIMIT = 100


@dataclass
class Query:
    """start, end: inclusive nanoseconds; an end of 0 is open. limit None: all rows. direction: backward or forward, in
    any case. tenant: rows of this tenant only. ordered: sort even without a limit, which sorts all that matches."""

    predicates: list[Predicate] = field(default_factory=list)
    start: int = 0
    end: int = 0
    limit: int | None = DEFAULT_LIMIT
    direction: str = "backward"
    program: Program = field(default_factory=Program)
    tenant: str | None = None
    ordered: bool = False

    def __post_init__(self) -> None:
        self.direction = self.direction.lower()
        if self.direction not in ("backward", "forward"):
            raise QueryError(f"direction {self.direction!r} is neither backward nor forward")


def in_window(logs: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with start <= ts_ns <= end; the day partition, if there, is bounded too."""
    if start > 0:
        logs = logs.where(F.col("ts_ns") >= start)
    if end > 0:
        logs = logs.where(F.col("ts_ns") <= end)
    if "day" in logs.columns:
        day = lambda ns: F.lit(ns // 86_400_000_000_000)  # noqa: E731  days since 1970
        if start > 0:
            logs = logs.where(F.col("day") >= F.date_from_unix_date(day(start).cast("int")))
        if end > 0:
            logs = logs.where(F.col("day") <= F.date_from_unix_date(day(end).cast("int")))
    return logs


def total_order(logs: DataFrame, direction: str) -> list[Column]:
    """Time by the direction; line, extra, level and service ascending either way."""
    ts = F.desc("ts_ns") if direction == "backward" else F.asc("ts_ns")
    return [ts, *[F.asc(c) for c in ("line", "extra", "level", "service") if c in logs.columns]]


def matching(logs: DataFrame, query: Query, templates: Templates | None = None, materialized: bool = True) -> DataFrame:
    """All rows that satisfy the query, with the columns its stages read."""
    templates = templates or Templates()
    if query.tenant is not None:
        logs = logs.where(F.col("tenant") == query.tenant)
    logs = in_window(logs, query.start, query.end)
    own = Scope(logs, templates, materialized)
    for p in query.predicates:
        if isinstance(p, TypedCompare):
            p.check(templates)
    plain = [p for p in query.predicates if not _reads_stage(p)]
    late = [p for p in query.predicates if _reads_stage(p)]
    if plain:  # before any stage reads the line
        logs = logs.where(all_of(plain, own))
    logs = query.program.extend(logs)
    if late:
        logs = logs.where(all_of(late, Scope(logs, templates, materialized)))
    return logs


def _reads_stage(p: Predicate) -> bool:
    return isinstance(p, (DynamicCompare, Custom))


def execute(logs: DataFrame, query: Query, templates: Templates | None = None, materialized: bool = True) -> DataFrame:
    """The query's rows, in order if there is a limit, with result_labels where its stages read labels."""
    out = matching(logs, query, templates, materialized)
    if query.program.parses():
        out = out.withColumn("result_labels", query.program.labels(out)).drop(*[c for c in out.columns if c.startswith("__s")])
    if query.limit is None and not query.ordered:
        return out
    out = out.orderBy(*total_order(out, query.direction))
    return out if query.limit is None else out.limit(query.limit)


def execute_by_day(logs: DataFrame, query: Query, templates: Templates | None = None) -> DataFrame:
    """As execute, for long histories partitioned by day: days are read newest (or oldest) first until the limit is met.

    Only counts of at most `limit` rows come to the driver."""
    if "day" not in logs.columns or query.limit is None:
        return execute(logs, query, templates)
    days = sorted((r["day"] for r in in_window(logs, query.start, query.end).select("day").distinct().collect()), reverse=query.direction == "backward")
    chosen, have, step = [], 0, 1
    while days and have < query.limit:
        chosen, days, step = chosen + days[:step], days[step:], 2 * step
        have = matching(logs.where(F.col("day").isin(chosen)), query, templates).limit(query.limit).count()
    return execute(logs.where(F.col("day").isin(chosen)), query, templates)


def streams(rows: DataFrame, labels: str = "labels", direction: str = "forward") -> DataFrame:
    """Rows of a result grouped by their labels: labels, values (arrays of [ts_ns as text, line]) in the order of the
    direction, lines of one time in theirs. A stream is one row: meant for results with a limit."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))
    sign = -1 if direction.lower() == "backward" else 1
    grouped = rows.withColumn("stream", key).groupBy("stream").agg(F.sort_array(F.collect_list(F.struct((F.col("ts_ns") * sign).alias("at"), "line", "ts_ns"))).alias("v"))
    return grouped.select("stream", F.transform("v", lambda x: F.array(x["ts_ns"].cast("string"), x["line"])).alias("values"))
