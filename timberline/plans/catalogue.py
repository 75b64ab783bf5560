"""The registered log queries, over a log view of the tables, and the same in SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import discovery
from timberline.operators.metric import MOST_STEPS, execute_metric, instant
from timberline.operators.query import execute, streams
from timberline.operators.stages import ERROR
from timberline.operators.templates import Templates
from timberline.plans.translate import log_query, metric_query
from timberline.sources import push
from timberline.sources.logs import decode_push, ingest, load, log_rows, matrix, overlay, stream_objects, vector

TEMPLATES = Templates(
    {"latency": "took={ms:int}ms", "code": "code={n:int};", "val": "val={v:float} ", "word": "kind={w:str} ", "id": "id={u:uuid} "},
    literals=("took=1",),
)
KEYS = ["app", "k"]
T0 = 1_704_067_200_000_000_000  # 2024-01-01
DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000


def _workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def events_as_logs(spark: SparkSession, sf_dir: str, line=None) -> DataFrame:
    """events as log rows; line: another line than the usual, of columns of events."""
    _workers(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    took = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" took="), F.floor("value").cast("bigint").cast("string"), F.lit("ms code="), k, F.lit(";"))
    rows = e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        (took if line is None else line).alias("line"),
        F.col("props").alias("extra"),
        F.create_map(F.lit("app"), F.col("event_type"), F.lit("k"), k).alias("labels"),
    )
    return log_rows(rows)


_STORED: dict[tuple[str, str, int | None], str] = {}


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; in local mode, where none is set, one of this machine's."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="timberline-")


def stored_logs(spark: SparkSession, sf_dir: str, line: Callable | None = None) -> DataFrame:
    """events_as_logs as an ingested table, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, None if line is None else id(line))
    if key not in _STORED:
        path = f"{_shared_folder(spark)}/timberline-logs-{uuid.uuid4().hex}"
        ingest(events_as_logs(spark, sf_dir, None if line is None else line()), path, TEMPLATES)
        _STORED[key] = path
    return load(spark, _STORED[key])


def _logs(text: str, line: Callable | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A registered log query: over the stored table if it compares a field, over rows made from events if not."""
    typed = any(name in text for name in TEMPLATES.fields)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = stored_logs(spark, sf_dir, line) if typed else events_as_logs(spark, sf_dir, None if line is None else line())
        q = log_query(text, TEMPLATES, **({"limit": None} | options))
        return execute(logs, q, TEMPLATES).select("ts_ns", F.col("labels")["app"].alias("app"), "line")

    return run


_LINE = "concat('user=', user_id, ' took=', cast(floor(value) as bigint), 'ms code=', json_extract_string(props, '$.k'), ';')"


def _sql_logs(where: str, line: str = _LINE, tail: str = "") -> str:
    return f"""with logs as (select epoch_us(ts) * 1000 as ts_ns, event_type as app, json_extract_string(props, '$.k') as k, user_id, value, {line} as line from events)
select ts_ns, app, line from logs where {where} {tail}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


_MS = "cast(regexp_extract(line, 'took=([0-9]+)ms', 1) as bigint)"
_TOP = "order by ts_ns desc, line limit 100"
for _name, _text, _where, _tail in (
    ("flagship", '{app="error"} | latency_ms > 200', f"app = 'error' and {_MS} > 200", _TOP),
    ("line_contains", '{} |= "took=1"', "contains(line, 'took=1')", ""),
    ("line_not_contains", '{} != "took=1"', "not contains(line, 'took=1')", ""),
    ("line_regex", '{} |~ "took=[12]\\\\d?ms"', r"regexp_matches(line, 'took=[12]\d?ms')", ""),
    ("line_not_regex", '{} !~ "took=[12]"', "not regexp_matches(line, 'took=[12]')", ""),
    ("label_eq", '{app="click"}', "app = 'click'", ""),
    ("label_ne", '{app!="click"}', "app <> 'click'", ""),
    ("label_eq_empty", '{region=""}', "true", ""),
    ("label_regex", '{app=~"c.*|view"}', "regexp_full_match(app, 'c.*|view')", ""),
    ("label_not_regex", '{app!~"c.*"}', "not regexp_full_match(app, 'c.*')", ""),
    ("label_numeric_ge", "{} | k >= 50", "cast(k as double) >= 50", ""),
    ("label_number_as_text", "{} | k = 50", "k = '50'", ""),
    ("typed_gt", "{} | latency_ms > 150", f"{_MS} > 150", ""),
    ("typed_ge", "{} | latency_ms >= 150", f"{_MS} >= 150", ""),
    ("typed_lt", "{} | latency_ms < 5", f"{_MS} < 5", ""),
    ("typed_le", "{} | latency_ms <= 5", f"{_MS} <= 5", ""),
    ("typed_eq", "{} | latency_ms = 100", f"{_MS} = 100", ""),
    ("typed_ne", "{} | latency_ms != 100", f"{_MS} <> 100", ""),
    ("conj_typed_label_line", '{app=~"view|error"} |= "user=1" | latency_ms >= 100 and code_n < 20 | k != "3"', f"app in ('view', 'error') and contains(line, 'user=1') and {_MS} >= 100 and cast(k as bigint) < 20 and k <> '3'", ""),
    ("stage_pattern", '{} | pattern "user=<user> took=<took>ms code=<c>;" | took > 150 | c = "7"', "value >= 151 and k = '7'", ""),
    ("stage_regexp", '{} | regexp "user=(?P<u>[0-9]+) took=(?P<t>[0-9]+)" | u = "12" | t < 100', "user_id = 12 and value < 100", ""),
    ("stage_logfmt", '{} | logfmt | user = "7"', "user_id = 7", ""),
    ("structural_match", '{} | pattern "<_>took=<latency_ms>ms<_>" | latency_ms > 300', f"{_MS} > 300", ""),
    ("dynamic_numeric", '{} | logfmt | user >= 140', "user_id >= 140", ""),
    ("dynamic_string", '{} | logfmt | user != "7"', "user_id <> 7", ""),
    ("dynamic_regex", '{} | logfmt | user =~ "1.?"', "regexp_full_match(cast(user_id as varchar), '1.?')", ""),
    ("extracted_suffix", '{} | regexp "took=(?P<k>[0-9]+)" | k_extracted > 100', "floor(value) > 100", ""),
    ("first_value_wins", '{} | regexp "user=(?P<x>[0-9]+)" | regexp "took=(?P<x>[0-9]+)" | x < 10', "user_id < 10", ""),
):
    _add(_name, _logs(_text, **({"limit": 100} if _tail else {})), _sql_logs(_where, tail=_tail))

_add("topk_backward", _logs("{}", limit=25), _sql_logs("true", tail="order by ts_ns desc, line limit 25"))
_add("topk_forward", _logs("{}", limit=25, direction="forward"), _sql_logs("true", tail="order by ts_ns, line limit 25"))
_add("time_window_inclusive", _logs("{}", start=T0 + DAY, end=T0 + 2 * DAY), _sql_logs(f"ts_ns between {T0 + DAY} and {T0 + 2 * DAY}"))


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).withColumn("ts_ns", F.expr(f"ts_ns - ts_ns % {DAY}"))
    return execute(logs, log_query("{}", limit=50), TEMPLATES).select("ts_ns", "line")


_add("topk_ties", _ties, f"select epoch_us(ts) * 1000 - epoch_us(ts) * 1000 % {DAY} as ts_ns, {_LINE} as line from events order by 1 desc, 2, props limit 50")

# Lines of other shapes
_USER, _VALUE = (lambda: F.col("user_id").cast("string")), (lambda: F.floor("value").cast("bigint").cast("string"))
_two = lambda: F.concat(F.lit("took="), _VALUE(), F.lit("ms then took="), (F.floor("value") + 1).cast("bigint").cast("string"), F.lit("ms"))
_add("typed_multi_occurrence", _logs("{} | latency_ms = 101", _two), _sql_logs("floor(value) in (100, 101)", "concat('took=', cast(floor(value) as bigint), 'ms then took=', cast(floor(value) + 1 as bigint), 'ms')"))
_float = lambda: F.concat(F.lit("val="), F.col("user_id").cast("string"), F.lit(".25 end"))
_add("typed_float", _logs("{} | val_v > 99.25", _float), _sql_logs("user_id > 99", "concat('val=', user_id, '.25 end')"))
_kind = lambda: F.concat(F.lit("kind="), F.col("event_type"), F.lit(" end"))
_add("typed_str", _logs('{} | word_w >= "purchase"', _kind), _sql_logs("app >= 'purchase'", "concat('kind=', event_type, ' end')"))
_md5 = lambda: F.md5(F.col("user_id").cast("string").cast("binary"))
_uuid = lambda: F.concat(F.lit("id="), F.concat_ws("-", *[F.substring(_md5(), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(" end"))
_add(
    "typed_uuid",
    _logs("{} | id_u < \"80000000-0000-0000-0000-000000000000\"", _uuid),
    _sql_logs("md5(cast(user_id as varchar)) < '8'", "concat('id=', md5(cast(user_id as varchar))[1:8], '-', md5(cast(user_id as varchar))[9:12], '-', md5(cast(user_id as varchar))[13:16], '-', md5(cast(user_id as varchar))[17:20], '-', md5(cast(user_id as varchar))[21:32], ' end')"),
)
_json = lambda: F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"u":'), _USER(), F.lit(',"in":{"v":'), _VALUE(), F.lit("},"))).otherwise(F.concat(F.lit('{"u":'), _USER(), F.lit(',"in":{"v":'), _VALUE(), F.lit("}}")))
_JSON = "case when user_id % 3 = 0 then concat('{\"u\":', user_id, ',\"in\":{\"v\":', cast(floor(value) as bigint), '},') else concat('{\"u\":', user_id, ',\"in\":{\"v\":', cast(floor(value) as bigint), '}}') end"
_add("stage_json", _logs("{} | json | in_v > 100", _json), _sql_logs("floor(value) > 100", _JSON))
_add("json_error", _logs('{} | json | __error__ != ""', _json), _sql_logs("user_id % 3 = 0", _JSON))
_add("drop_error", _logs('{} | json | drop __error__ | __error__ = ""', _json), _sql_logs("true", _JSON))


def _result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execute(events_as_logs(spark, sf_dir, _json()), log_query('{app="view"} | json', limit=None))
    r = F.col("result_labels")
    return out.select("ts_ns", r["u"].alias("u"), r["in_v"].alias("in_v"), r["app"].alias("own"), r[ERROR].alias("error"))


_add("result_labels", _result_labels, "select epoch_us(ts) * 1000 as ts_ns, cast(user_id as varchar) as u, cast(cast(floor(value) as bigint) as varchar) as in_v, event_type as own, case when user_id % 3 = 0 then 'JSONParserErr' end as error from events where event_type = 'view'")


def _forced_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = log_query("{} | latency_ms > 250", TEMPLATES, limit=None)
    return execute(stored_logs(spark, sf_dir), q, TEMPLATES, materialized=False).select("ts_ns", "line")


_add("forced_scan", _forced_scan, f"select epoch_us(ts) * 1000 as ts_ns, {_LINE} as line from events where floor(value) > 250")
_add("template_stats", lambda spark, d: TEMPLATES.stats(events_as_logs(spark, d)), "select template, case when template in ('latency', 'code') then n else 0 end as candidates, case when template in ('latency', 'code') then n else 0 end as matches, cast(0 as bigint) as failures from (values ('latency'), ('code'), ('val'), ('word'), ('id')) t(template), (select count(*) as n from events)")

# Metric queries


def _span(spark: SparkSession, sf_dir: str, unit: int = DAY) -> tuple[int, int]:
    """Whole units of time that hold all events: the first and the last time a metric is taken at."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    lo, hi = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(ns), F.max(ns)).first()
    return (lo or 0) // unit * unit, -(-(hi or 0) // unit) * unit


_LO, _HI = (f"(select {how} from events)" for how in (f"min(epoch_us(ts) * 1000) // {DAY} * {DAY}", f"(max(epoch_us(ts) * 1000) + {DAY} - 1) // {DAY} * {DAY}"))


def _metric(text: str, step: int = DAY, at_end: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A registered metric query over all events; at_end: at the last time only, over a range {} that holds them all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lo, hi = _span(spark, sf_dir)
        q = metric_query(text.replace("[all]", f"[{(hi - lo) // HOUR + 1}h]"), TEMPLATES, start=lo, end=hi, step=step)
        out = execute_metric(stored_logs(spark, sf_dir), instant(q, hi) if at_end else q, TEMPLATES)
        return out.select(F.col("labels")["app"].alias("app"), F.col("labels")["k"].alias("k"), "ts_ns", F.round("value", 6).alias("value"))

    return run


def _sql_metric(value: str, hours: float, step: int = DAY, where: str = "true", outer: str | None = None, keep: tuple = ("app", "k"), at_end: bool = False) -> str:
    grid = f"select {_HI} as t" if at_end else f"select unnest(range({_LO}, {_HI} + 1, {step})) as t"
    span = f"{_HI} - {_LO} + {HOUR}" if at_end else f"{round(hours * HOUR)}"
    kept = ", ".join(c if c in keep else f"cast(null as varchar) as {c}" for c in ("app", "k"))
    streams_ = f"""with logs as (select epoch_us(ts) * 1000 as ts_ns, event_type as app, json_extract_string(props, '$.k') as k, floor(value) as x, user_id from events),
grid as ({grid}), s as (select app, k, t as ts_ns, {value} as v from logs join grid on logs.ts_ns > t - ({span}) and logs.ts_ns <= t where {where} group by app, k, t)"""
    if outer is None:
        return f"{streams_} select app, k, cast(ts_ns as bigint) as ts_ns, round(cast(v as double), 6) as value from s"
    groups = ", ".join([*keep, "ts_ns"])
    return f"{streams_} select {kept}, cast(ts_ns as bigint) as ts_ns, round(cast({outer}(v) as double), 6) as value from s group by {groups}"


for _name, _text, _args in (
    ("rate", 'rate({app="error"}[48h])', dict(value="count(*) / (48 * 3600.0)", hours=48, where="app = 'error'")),
    ("rate_unwrap", "rate({} | unwrap latency_ms [24h])", dict(value="sum(x) / (24 * 3600.0)", hours=24)),
    ("sum_over_time", "sum_over_time({} | unwrap latency_ms [48h])", dict(value="sum(x)", hours=48)),
    ("avg_over_time", "avg_over_time({} | unwrap latency_ms [48h])", dict(value="avg(x)", hours=48)),
    ("max_over_time", "max_over_time({} | unwrap latency_ms [30h])", dict(value="max(x)", hours=30)),
    ("min_over_time", "min_over_time({} | unwrap latency_ms [30h])", dict(value="min(x)", hours=30)),
    ("sum_by", "sum by (app) (count_over_time({}[24h]))", dict(value="count(*)", hours=24, outer="sum", keep=("app",))),
    ("avg_by", "avg by (app) (sum_over_time({} | unwrap latency_ms [24h]))", dict(value="sum(x)", hours=24, outer="avg", keep=("app",))),
    ("max_by", "max(count_over_time({}[48h])) by (app)", dict(value="count(*)", hours=48, outer="max", keep=("app",))),
    ("min_by", "min by (k) (count_over_time({}[48h]))", dict(value="count(*)", hours=48, outer="min", keep=("k",))),
    ("count_by", "count by (app) (count_over_time({}[24h]))", dict(value="count(*)", hours=24, outer="count", keep=("app",))),
    ("sum_without", "sum without (k) (count_over_time({} | latency_ms > 100 [24h]))", dict(value="count(*)", hours=24, where="x > 100", outer="sum", keep=("app",))),
    ("sum_all", "sum(count_over_time({}[24h]))", dict(value="count(*)", hours=24, outer="sum", keep=())),
):
    _add(_name, _metric(_text), _sql_metric(**_args))
_add("count_over_time", _metric("count_over_time({}[6h])", 6 * HOUR), _sql_metric("count(*)", 6, 6 * HOUR))
_add("metric_fine_steps", _metric("sum by (app) (count_over_time({}[90m]))", HOUR), _sql_metric("count(*)", 1.5, HOUR, outer="sum", keep=("app",)))
_add("instant_metric", _metric("sum by (app) (count_over_time({}[all]))", at_end=True), _sql_metric("count(*)", 0, outer="sum", keep=("app",), at_end=True))


def _response(shape: Callable, at_end: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lo, hi = _span(spark, sf_dir)
        q = metric_query(f"sum by (app) (sum_over_time({{}} | unwrap latency_ms [{(hi - lo) // HOUR + 1}h]))" if at_end else "sum by (app) (sum_over_time({} | unwrap latency_ms [24h]))", TEMPLATES, start=lo, end=hi, step=DAY)
        return shape(execute_metric(stored_logs(spark, sf_dir), instant(q, hi) if at_end else q, TEMPLATES))

    return run


_POINT = "concat('[', t // 1000000000, ',\"', cast(v as bigint), '\"]')"
_SUMS = "with g as ({grid}), s as (select event_type as app, t, sum(floor(value)) as v from events join g on epoch_us(ts) * 1000 > t - {span} and epoch_us(ts) * 1000 <= t group by event_type, t) "
_add("response_matrix", _response(matrix, False), _SUMS.format(grid=f"select unnest(range({_LO}, {_HI} + 1, {DAY})) as t", span=DAY) + f"select concat('{{\"metric\":{{\"app\":\"', app, '\"}},\"values\":[', string_agg({_POINT}, ',' order by t), ']}}') as json from s group by app")
_add("response_vector", _response(vector, True), _SUMS.format(grid=f"select {_HI} as t", span=f"({_HI} - {_LO} + {HOUR})") + f"select concat('{{\"metric\":{{\"app\":\"', app, '\"}},\"value\":', {_POINT}, '}}') as json from s")


def _response_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = execute(events_as_logs(spark, sf_dir), log_query("{}", limit=200)).withColumn("labels", F.map_filter("labels", lambda k, _: k == "app"))
    return stream_objects(streams(logs, direction="backward"))


_add("response_streams", _response_streams, f"with r as (select event_type as app, epoch_us(ts) * 1000 as t, {_LINE} as line from events order by t desc, line limit 200) select concat('{{\"stream\":{{\"app\":\"', app, '\"}},\"values\":[', string_agg(concat('[\"', t, '\",\"', line, '\"]'), ',' order by t desc, line), ']}}') as json from r group by app")

# Discovery
_add("labels", lambda spark, d: discovery.labels(events_as_logs(spark, d), KEYS), "select unnest(['app', 'k']) as label")
_add("label_values", lambda spark, d: discovery.label_values(events_as_logs(spark, d), "app", KEYS), "select distinct event_type as value from events")
_add("series", lambda spark, d: discovery.series(events_as_logs(spark, d), KEYS), "select distinct concat('{\"app\":\"', event_type, '\",\"k\":\"', json_extract_string(props, '$.k'), '\"}') as series from events")
_add("index_stats", lambda spark, d: discovery.index_stats(events_as_logs(spark, d)), "select count(distinct (event_type, json_extract_string(props, '$.k'))) as streams, count(*) as entries, count(*) * 120 as bytes from events")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams(events_as_logs(spark, sf_dir).withColumn("labels", F.map_filter("labels", lambda k, _: k == "app")))
    return out.select("stream", F.size("values").cast("long").alias("n"), F.element_at("values", 1)[1].alias("first"))


_add("stream_grouping", _grouped, f"select concat('{{\"app\":\"', event_type, '\"}}') as stream, count(*) as n, arg_min({_LINE}, ts) as first from events group by event_type")

# Pushes


def _push(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    body = F.concat(F.lit('{"streams":[{"stream":{"app":"'), F.col("event_type"), F.lit('","level":"warning"},"values":[["'), ns, F.lit('","user='), F.col("user_id").cast("string"), F.lit('",{"app":"x'), F.col("user_id").cast("string"), F.lit('"}]]}]}'))
    return decode_push(e.select(body.alias("body"))).select("ts_ns", "line", "level", F.col("labels")["app"].alias("app"))


def _bad_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with a bad time, a missing line, a number for a line, or text behind the object are refused whole."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.array(*map(F.lit, ('["1","a"]]}]}', '["1","a"],["x","b"]]}]}', '["1","a"],["2"]]}]}', '["1",7]]}]}', '["1","a"]]}]} more')))
    body = F.concat(F.lit('{"other":{"streams":7},"STREAMS":[{"stream":{"Streams":"s"},"values":['), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")))
    pushes = push.read_pushes(e.select("event_id", body.alias("body")))
    return pushes.select("event_id", F.col("push.error").isNotNull().alias("refused"), F.size("push.entries").cast("long").alias("n"), F.get(F.col("push.entries")["labels"], F.lit(0))["Streams"].alias("label"))


_add("push_bad_body", _bad_bodies, "select event_id, event_id % 5 <> 0 as refused, cast(event_id % 5 = 0 as bigint) as n, case when event_id % 5 = 0 then 's' end as label from events")

_add("push_decode", _push, "select epoch_us(ts) * 1000 as ts_ns, concat('user=', user_id) as line, cast(2 as tinyint) as level, concat('x', user_id) as app from events")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = overlay(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("s")), F.create_map(F.lit("b"), F.col("user_id").cast("string")))
    return e.select("event_id", m["a"].alias("a"), m["b"].alias("b"))


_add("push_metadata_overlay", _overlay, "select event_id, event_type as a, cast(user_id as varchar) as b from events")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("trace", "Notice", " WARNING", "crit", "nonsense"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").alias("ts_ns"), F.lit("x").alias("line"), F.create_map(F.lit("level"), text).alias("labels"))
    return log_rows(e).select("ts_ns", F.col("level").cast("int").alias("level"))


_add("level_alias", _levels, "select event_id as ts_ns, [0, 1, 2, 3, 1][event_id % 5 + 1] as level from events")


def _level_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).withColumn("level", F.when(F.col("labels")["app"] == "error", 3).otherwise(1).cast("tinyint"))
    return execute(logs, log_query('{level="ERROR"}', limit=None)).select("ts_ns", "line")


_add("level_label", _level_label, f"select epoch_us(ts) * 1000 as ts_ns, {_LINE} as line from events where event_type = 'error'")


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(spark, sf_dir).withColumn("tenant", F.when(F.col("labels")["k"].cast("int") % 3 == 0, "acme").otherwise("globex"))
    return execute(logs, log_query('{app="view"}', limit=None, tenant="acme")).select("ts_ns", "line")


_add("tenant_scope", _tenants, f"select epoch_us(ts) * 1000 as ts_ns, {_LINE} as line from events where event_type = 'view' and cast(json_extract_string(props, '$.k') as int) % 3 = 0")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ts_ns"), F.col("text").alias("line"), F.create_map(F.lit("lang"), F.col("lang")).alias("labels"))
    return execute(log_rows(rows), log_query('{lang="de"} |~ "ü[a-z]*ß" != "die die"', limit=None)).select("ts_ns")


_add("documents_line_filter", _documents, "select doc_id as ts_ns from documents where lang = 'de' and regexp_matches(text, 'ü[a-z]*ß') and not contains(text, 'die die')")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 10**9).alias("ts_ns"), F.col("text").alias("line"), F.create_map(F.lit("role"), F.col("role")).alias("labels"))
    lo, hi = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    step = 100 * 10**9
    first, last = -(-(lo or 0) // step), -(-(hi or 0) // step)  # the steps whose windows hold the smallest and the largest
    parts = []
    for k in range(first, last + 1, MOST_STEPS):
        q = metric_query("sum by (role) (count_over_time({}[100s]))", start=k * step, end=min(k + MOST_STEPS - 1, last) * step, step=step)
        parts.append(execute_metric(log_rows(rows), q))
    return reduce(DataFrame.union, parts).select(F.col("labels")["role"].alias("role"), "ts_ns", "value")


_add("conversations_by_role", _conversations, "with g as (select unnest(range(0, 1001, 100)) as t) select role, t * 1000000000 as ts_ns, cast(count(*) as double) as value from conversations join g on conv_id > t - 100 and conv_id <= t group by role, t")
