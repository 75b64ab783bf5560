"""The query language: what it accepts, how it prints, what it refuses."""

import pytest

from timberline.functions.values import QueryError, parse_duration
from timberline.operators.templates import Template, Templates
from timberline.plans.logql import format_query, parse
from timberline.plans.translate import equal_template, metric_query, translate
from timberline.operators.stages import PatternStage

T = Templates({"latency": "took {ms:int}ms", "trip": "trip:{id:str}", "dur": "dur {s:float}s"}, ("panic:",))


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ("{}", "{}"),
        ('{a="b", c!~`x.*`} |= "y" != "z"', '{a="b",c!~"x.*"} |= "y" != "z"'),
        ("{a='it\\'s'}", '{a="it\'s"}'),
        ('{} | latency_ms > 5 and x == "y", z <= 1.5', '{} | latency_ms > 5 | x = "y" | z <= 1.5'),
        ('{} | json | drop __error__, __error_details__', "{} | json | drop __error__, __error_details__"),
        ('{} | pattern "<a> <_>" | unwrap a', '{} | pattern "<a> <_>" | unwrap a'),
        ('{} | json = "x"', '{} | json = "x"'),
        ('{a="\\u00e9\\n"}', '{a="é\\n"}'),
    ],
)
def test_print(text, printed):
    assert format_query(text) == printed
    assert format_query(printed) == printed


@pytest.mark.parametrize(
    "text",
    [
        "", "{", '{a=="b"}', '{a="b"', '{a="b"} x', '{} | a > 1s', '{} | a > 1KB', '{} | a = 1 or b = 2', "{} | json a", '{} | logfmt --strict',
        '{} | line_format "x"', "{} | unpack", "topk(1, rate({}[5m]))", "rate({}[5m] offset 1m)", "rate({}[5m]) + rate({}[5m])", "sum(sum(rate({}[5m])))",
        '{a="\\q"}', "{} |= 5", "bytes_rate({}[5m])", "{} | keep", '{a=1}', "rate({})",
    ],
)
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ['{} | keep a', '{} | drop a', '{} | pattern "abc"', '{} | pattern "<a><b>"', '{} | regexp "(x)"', '{} | regexp "(?P<a>x)(?P<a>y)"', '{} |~ "(?=x)"', '{} |~ "a**"', '{} | latency_ms =~ "1"', '{} | latency_ms > 1.5', '{} | json | x > "a"'])
def test_refused_in_translation(text):
    with pytest.raises(QueryError):
        translate(parse(text), T)


def test_metric_options():
    q = metric_query("sum(rate({} | unwrap latency_ms [90s])) by (a, b)", T, start=0, end=10, step=1)
    assert (q.op, q.range_ns, q.vector, q.grouping, q.unwrap) == ("rate", 90 * 10**9, "sum", ["a", "b"], "latency_ms")
    assert metric_query("sum without () (rate({}[5m]))").grouping is None
    with pytest.raises(QueryError):
        metric_query("sum_over_time({}[5m])")
    with pytest.raises(QueryError):
        metric_query("rate({}[0])")


@pytest.mark.parametrize(("text", "ns"), [("5m", 300 * 10**9), ("1h30m", 5400 * 10**9), ("1.5h", 5400 * 10**9), ("0", 0), ("2d", 172800 * 10**9), ("10ms", 10**7)])
def test_durations(text, ns):
    assert parse_duration(text) == ns


@pytest.mark.parametrize("text", ["", "5", "-5m", "5x", "1.2.3s", "300y", "m"])
def test_bad_durations(text):
    with pytest.raises(QueryError):
        parse_duration(text)


@pytest.mark.parametrize("pattern", ["", "{a:int} x", "a {x:int}", "abc {x:int}5", "abc {x:float}e", "abc {x:int}{y:int}", "abc {x:date}", "abc {x", "abc {x:int} {x:str}"])
def test_bad_templates(pattern):
    with pytest.raises(QueryError):
        Template("t", pattern)


def test_equal_template():
    t, _ = equal_template(PatternStage("<_>took <latency_ms>ms<_>"), T)
    assert t.name == "latency"
    for other in ("took <latency_ms>ms", "<_>took <latency_ms>", "<_>took <ms>ms", "<_>took <_>x<latency_ms>ms"):
        assert equal_template(PatternStage(other), T)[0] is None
