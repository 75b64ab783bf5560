"""Metric queries: a range aggregation per stream on a grid of steps, then one across streams.

The window of a step t is (t - range, t]. Each row goes to the steps whose windows hold it by integer arithmetic, not
by a join; where range is a multiple of step, rows are first summed per step, so a row is written once whatever the
overlap, and only those sums are spread out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.values import QueryError, float_of
from timberline.operators.predicates import Predicate, Scope
from timberline.operators.query import Query, matching
from timberline.operators.stages import Program
from timberline.operators.templates import Templates

MOST_STEPS, MOST_ENTRIES = 11_000, 20_000_000
RANGE_OPS = ("count_over_time", "rate", "sum_over_time", "avg_over_time", "max_over_time", "min_over_time")
VECTOR_OPS = ("sum", "avg", "max", "min", "count")


@dataclass
class MetricQuery:
    op: str
    range_ns: int
    predicates: list[Predicate] = field(default_factory=list)
    unwrap: str | None = None
    vector: str | None = None
    grouping: list[str] | None = None
    without: bool = False
    start: int = 0
    end: int = 0
    step: int = 0
    program: Program = field(default_factory=Program)
    unwrap_at: int | None = None  # the stage before which a label to unwrap is read; None: no stage reads it
    series_labels: Callable[[DataFrame], Column] | None = None
    unwrap_value: Callable[[Scope], Column] | None = None
    tenant: str | None = None
    most_entries: int | None = None


def default_step(start: int, end: int) -> int:
    return max(1, (end - start) // 250 // 1_000_000_000) * 1_000_000_000


def canonical(labels: Column) -> Column:
    """One text for each label set."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def reduce_labels(labels: Column, grouping: list[str] | None, without: bool) -> Column:
    """by: the labels named; without: all but those; no grouping: none."""
    names = F.array(*map(F.lit, grouping)) if grouping else F.array().cast("array<string>")
    if without and grouping:
        return F.map_filter(labels, lambda k, _: ~F.array_contains(names, k))
    return F.map_filter(labels, lambda k, _: F.array_contains(names, k))


def _unwrapped(scope: Scope, q: MetricQuery) -> Column:
    if q.unwrap_value is not None:
        return q.unwrap_value(scope)
    if q.unwrap_at is not None:
        return float_of(q.program.value(scope, q.unwrap_at, q.unwrap))
    if q.unwrap in scope.templates.fields:
        values, _, _ = scope.typed(q.unwrap)
        kind = scope.templates.fields[q.unwrap][1].kind
        return F.get(values, F.lit(0)).cast("double") if kind in ("int", "float") else float_of(F.get(values, F.lit(0)))
    return float_of(scope.label(q.unwrap))


def execute_metric(logs: DataFrame, q: MetricQuery, templates: Templates | None = None, materialized: bool = True) -> DataFrame:
    """-> series (canonical labels), labels, ts_ns, value; ordered by series and time."""
    templates, step = templates or Templates(), q.step or default_step(q.start, q.end)
    if q.op not in RANGE_OPS or q.vector not in (None, *VECTOR_OPS):
        raise QueryError(f"unknown aggregation {q.op} {q.vector or ''}")
    if q.range_ns <= 0 or step <= 0:
        raise QueryError("range and step must be positive")
    if q.op.endswith("_over_time") and q.op != "count_over_time" and not q.unwrap and not q.unwrap_value:
        raise QueryError(f"{q.op} requires `| unwrap <field>`")
    n = (q.end - q.start) // step + 1 if q.end >= q.start else 0
    if n > MOST_STEPS:
        raise QueryError(f"too many steps: {n} of at most {MOST_STEPS}")
    rows = matching(logs, Query(q.predicates, program=q.program, tenant=q.tenant), templates, materialized)
    rows = rows.where((F.col("ts_ns") > q.start - q.range_ns) & (F.col("ts_ns") <= q.end)) if n else rows.where(F.lit(False))
    if q.most_entries is not None and rows.limit(q.most_entries + 1).count() > q.most_entries:
        raise QueryError(f"more than {q.most_entries} entries match")
    takes_value = q.op != "count_over_time" and (q.unwrap is not None or q.unwrap_value is not None)
    labels = q.series_labels(rows) if q.series_labels else q.program.labels(rows) if q.program.parses() else F.col("labels")
    if q.program.parses() and q.unwrap and takes_value:
        labels = F.map_filter(labels, lambda k, _: k != q.unwrap)
    x = _unwrapped(Scope(rows, templates, materialized), q) if takes_value else F.lit(1.0)
    rows = rows.select(F.coalesce(labels, F.create_map().cast("map<string,string>")).alias("labels"), "ts_ns", x.alias("x")).where("x is not null")

    at, ahead = F.col("ts_ns") - q.start, step - 1
    if q.range_ns % step == 0:  # sums per step first: the first window that holds a row, and range / step windows from there
        first = F.when(at <= 0, -F.expr(f"({q.start} - ts_ns) div {step}")).otherwise(F.expr(f"(ts_ns - {q.start} + {ahead}) div {step}"))
        part = rows.withColumn("k", first).groupBy("labels", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        width = q.range_ns // step
        spread = part.withColumn("k", F.explode(F.sequence(F.greatest("k", F.lit(0)), F.least(F.col("k") + width - 1, F.lit(max(n - 1, 0))))))
    else:
        lo = F.when(at <= 0, F.lit(0)).otherwise(F.expr(f"(ts_ns - {q.start} + {ahead}) div {step}"))
        hi = F.least(F.expr(f"(ts_ns + {q.range_ns - 1} - {q.start}) div {step}"), F.lit(max(n - 1, 0)))
        spread = rows.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("labels", F.explode(F.sequence("lo", "hi")).alias("k"), F.lit(1).alias("n"), F.col("x").alias("s"), F.col("x").alias("lo"), F.col("x").alias("hi"))
    seconds = q.range_ns / 1e9
    value = {
        "count_over_time": F.sum("n").cast("double"),
        "rate": F.sum("s") / seconds,
        "sum_over_time": F.sum("s"),
        "avg_over_time": F.sum("s") / F.sum("n"),
        "max_over_time": F.max("hi"),
        "min_over_time": F.min("lo"),
    }[q.op]
    out = spread.groupBy("labels", "k").agg(value.alias("value"))
    if q.vector:
        f = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": lambda c: F.count(c).cast("double")}[q.vector]
        out = out.groupBy(reduce_labels(F.col("labels"), q.grouping, q.without).alias("labels"), "k").agg(f("value").alias("value"))
    return out.select(canonical(F.col("labels")).alias("series"), "labels", (F.col("k") * step + q.start).alias("ts_ns"), "value").orderBy("series", "ts_ns")


def instant(q: MetricQuery, at: int) -> MetricQuery:
    """The same query at one time."""
    return MetricQuery(**{**q.__dict__, "start": at, "end": at, "step": 1_000_000_000})
