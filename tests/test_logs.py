"""Log queries against plain Python, in the materialised and the recomputed form."""

import json
import random
import re
import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.functions.text_udfs import read_extra, read_json, read_logfmt
from timberline.functions.values import Regex, float_of
from timberline.operators.metric import execute_metric
from timberline.operators.query import execute, execute_by_day
from timberline.operators.stages import PatternStage
from timberline.operators.templates import Templates
from timberline.plans import catalogue
from timberline.plans.translate import explain, log_query, metric_query
from timberline.sources.logs import compact, decode_push, expire, ingest, load, log_rows
from timberline.streaming.tail import ingest_stream, tail

T = Templates({"latency": "took {ms:int}ms", "trip": "trip:{id:str}", "delta": "delta {n:int} end", "dur": "dur {s:float}s"}, ("panic:",), ("region",))
T0 = 1_700_000_000 * 10**9


def rows(n=200, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        pieces = [r.choice([f"took {r.randint(0, 400)}ms", f"took {r.randint(0, 9)}.5ms", f"trip:T{i % 7}", "panic: x", f"delta {r.randint(-5, 5)} end", f"dur {r.randint(0, 3)}.5s", "took ms"]) for _ in range(r.randint(1, 3))]
        labels = r.choice([{"region": "eu", "code": "200"}, {"region": "us", "code": "OK"}, {"code": "500"}, {}])
        out.append((T0 + r.randint(0, 50) * 10**9, " ".join(pieces), labels))
    return out


def oracle_field(line, rx, cast):
    return [cast(m[2]) for m in re.finditer(f"(?=({rx}))", line)]


CASES = {
    "{} | latency_ms > 200": lambda x, l: any(v > 200 for v in oracle_field(x, r"took ([+-]?\d+)ms", int)),
    "{} | latency_ms = 7": lambda x, l: any(v == 7 for v in oracle_field(x, r"took ([+-]?\d+)ms", int)),
    "{} | latency_ms != 7": lambda x, l: (lambda v: not v or any(a != 7 for a in v))(oracle_field(x, r"took ([+-]?\d+)ms", int)),
    "{} | delta_n <= -2": lambda x, l: any(v <= -2 for v in oracle_field(x, r"delta ([+-]?\d+) end", int)),
    "{} | dur_s >= 1.5": lambda x, l: any(v >= 1.5 for v in oracle_field(x, r"dur (\d+\.\d)s", float)),
    '{} | trip_id = "T3"': lambda x, l: "trip:T3" in x,
    '{region="eu"} |= "panic:"': lambda x, l: l.get("region") == "eu" and "panic:" in x,
    '{region=""}': lambda x, l: "region" not in l,
    '{region!="eu"}': lambda x, l: l.get("region") != "eu",
    '{region=~"e.|"}': lambda x, l: l.get("region", "") in ("eu", ""),
    "{} | code >= 300": lambda x, l: l.get("code") == "500",
    '{} !~ "took [0-9]+ms" != "panic"': lambda x, l: not re.search("took [0-9]+ms", x) and "panic" not in x,
}


@pytest.fixture(scope="module")
def logs(spark):
    return log_rows(spark.createDataFrame(rows(), "ts_ns long, line string, labels map<string,string>")).cache()


@pytest.mark.parametrize("text", CASES)
def test_both_forms_match_plain_python(logs, text):
    want = sorted((ts, line) for ts, line, labels in rows() if CASES[text](line, labels))
    for source, form in ((T.materialize(logs), True), (logs, False)):
        got = execute(source, log_query(text, T, limit=None), T, materialized=form)
        assert sorted((r["ts_ns"], r["line"]) for r in got.collect()) == want


def test_order_limit_window(logs):
    want = sorted(rows(), key=lambda r: (-r[0], r[1]))[:10]
    got = execute(logs, log_query("{}", limit=10)).collect()
    assert [(r["ts_ns"], r["line"]) for r in got] == [(r[0], r[1]) for r in want]
    got = execute(logs, log_query("{}", start=T0, end=T0 + 5 * 10**9, limit=None)).collect()
    assert len(got) == sum(T0 <= r[0] <= T0 + 5 * 10**9 for r in rows())


def test_pattern_cases(spark):
    cases = [
        ("<a> b <c>", "x b y", {"a": "x", "c": "y"}), ("<a> b <c>", "x y", {"a": "x y"}), ("lit <a>", "no", {}), ("lit <a>", "lit ", {"a": ""}),
        ("<a>,<_>,<b>", "1,2,3", {"a": "1", "b": "3"}), ("<a>=<b>;", "k=v", {"a": "k", "b": "v"}), ("<a>\n<b>", "1\n2\n3", {"a": "1", "b": "2\n3"}), ("<a>x", "", {}),
    ]
    for expr, line, want in cases:
        got = spark.createDataFrame([(line,)], "line string").select(PatternStage(expr).struct(F.col("line")).alias("s")).first()["s"].asDict()
        assert {k: v for k, v in got.items() if v is not None} == want, (expr, line)


def test_readers():
    assert read_logfmt('a=1 b="x y" c= d e="q\\"r" "bad" =z f=g=h 9k=v a=2') == {"a": "1", "b": "x y", "e": 'q"r', "_9k": "v"}
    assert read_json('{"a":1.50,"b":{"c":true,"d":[1,{"x":2}]},"e":null,"a":2}') == ({"a": "1.50", "b_c": "true"}, None)
    assert read_json('{"a":"x","b":') == ({"a": "x"}, "JSONParserErr")
    assert read_json("[1]") == ({}, "JSONParserErr") and read_json('{"a":1} tail') == ({"a": "1"}, None)
    assert read_extra('{"a":1e2,"b":[1],"c":null,"d":false,"a":"z"}') == {"a": "z", "d": "false"} and read_extra('{"a":1') == {}


def test_floats_and_regexes(spark):
    texts = ["1.50", "12d", " 1", "1e400", "inf", "-Infinity", "NaN", "0x1p-2", ".5", "5.", "1_0", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(float_of(F.col("t"))).collect()]
    assert [None if x is None else repr(x) for x in got] == ["1.5", None, None, None, "inf", "-inf", "nan", "0.25", "0.5", "5.0", None, None]
    for pattern, text, want in (("a$", "a\n", False), (r"[[:alpha:]]+\d", "ab1", True), (r"^\s$", "\x0b", False), ("(?i)É", "é", True), ("a{,2}", "a{,2}", True), (r"\bfoo\b", "a foo b", True)):
        row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(Regex(pattern).java)).first()
        assert row[0] is want, pattern


def test_metric_matches_plain_python(logs):
    end, step = T0 + 60 * 10**9, 10 * 10**9
    for span in (20, 15):
        for op in ("count_over_time", "sum_over_time", "max_over_time", "avg_over_time"):
            inner = "{}" if op == "count_over_time" else "{} | unwrap latency_ms"
            got = execute_metric(logs, metric_query(f"{op}({inner} [{span}s])", T, start=T0, end=end, step=step), T).collect()
            want = {}
            for t in range(T0, end + 1, step):
                groups = {}
                for ts, line, labels in rows():
                    if t - span * 10**9 < ts <= t:
                        v = 1 if op == "count_over_time" else next(iter(oracle_field(line, r"took ([+-]?\d+)ms", int)), None)
                        if v is not None:
                            groups.setdefault(json.dumps(labels, sort_keys=True, separators=(",", ":")), []).append(v)
                for k, v in groups.items():
                    want[k, t] = {"count_over_time": len, "sum_over_time": sum, "max_over_time": max, "avg_over_time": lambda v: sum(v) / len(v)}[op](v)
            assert {(r["series"], r["ts_ns"]): round(r["value"], 9) for r in got} == {k: round(float(v), 9) for k, v in want.items()}


def test_pushdown(spark, tmp_path, logs):
    path = str(tmp_path / "t")
    ingest(logs, path, T)
    table = load(spark, path)
    assert "f_latency_ms__max" in explain("{} | latency_ms > 300", table, T)["pushed"][0]
    q = log_query("{} | latency_ms > 100", T, limit=None)
    assert execute(table, q, T).count() == execute(logs, q, T).count() > 0
    changed = Templates({"latency": "took {ms:int}m"})  # another pattern: the stored column isn't used
    assert execute(table, log_query("{} | latency_ms > 100", changed, limit=None), changed).count() == execute(logs, log_query("{} | latency_ms > 100", changed, limit=None), changed).count()
    assert [r["line"] for r in execute_by_day(table, log_query("{}", limit=5)).collect()] == [r["line"] for r in execute(logs, log_query("{}", limit=5)).collect()]
    compact(spark, path, str(tmp_path / "c"), T)
    assert load(spark, str(tmp_path / "c")).count() == logs.count()
    assert expire(spark, path, dt.date(2030, 1, 1)) and not expire(spark, path, dt.date(2030, 1, 1))


def test_push_and_stream(spark, tmp_path):
    body = json.dumps({"Streams": [{"stream": {"app": "a", "level": "err"}, "values": [["5", "took 7ms", {"app": "b"}], ["6", "x" * 5000]]}, {"stream": {}, "values": [["7", "y"]]}]})
    got = {r["ts_ns"]: r for r in decode_push(spark.createDataFrame([(body,), ("nonsense",)], "body string")).collect()}
    assert set(got) == {5, 6, 7} and got[5]["labels"] == {"app": "b", "level": "err"} and got[5]["level"] == 3 and got[7]["level"] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(body)
    path, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    bodies = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    ingest_stream(bodies, path, bad, str(tmp_path / "cp"), T).awaitTermination()
    assert sorted(r["ts_ns"] for r in spark.read.parquet(path).collect()) == [5, 7] and spark.read.parquet(bad).count() == 1
    live = tail(spark, path, '{app="b"} | latency_ms > 5', T, since_ns=0)
    q = live.writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["line"] for r in spark.table("live").collect()] == ["took 7ms"]


@pytest.mark.parametrize("steps", [7, 11_000])
def test_conversations_are_all_counted(spark, tmp_path, monkeypatch, steps):
    monkeypatch.setattr(catalogue, "MOST_STEPS", steps, raising=False)
    ids = [*range(150, 2350, 3), 2400, 2400, 9_001]
    want = {}
    for i in ids:
        key = ("user" if i % 2 else "assistant", -(-i // 100) * 100 * 10**9)
        want[key] = want.get(key, 0) + 1
    turns = [(i, 0, "user" if i % 2 else "assistant", "x") for i in ids]
    for part, name in ((turns, "a"), ([], "none")):
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    run = catalogue.QUERIES["conversations_by_role"]
    got = run(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(want) and {(r["role"], r["ts_ns"]): r["value"] for r in got} == want
    assert run(spark, f"{tmp_path}/none").count() == 0
