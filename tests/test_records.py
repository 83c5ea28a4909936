import pytest
from pyspark.sql import functions as F

from quarrylog.frame import LogFrame
from quarrylog.operators.records import ENTRY, Predefined, parse_entry, records
from quarrylog.settings import DEFAULTS, merged

PREDEFINED = Predefined(DEFAULTS)


def parsed(text, **options):
    return list(parse_entry(text, PREDEFINED, **options))


def test_stream_stops_at_the_first_fault():
    rows = parsed('{"msg":"one"}{nothing here{"msg":"two"}')
    assert [r["parse_status"] for r in rows] == ["ok", "invalid"]
    assert rows[0]["message"]["text"] == "one"


def test_duplicates_and_number_texts_stay():
    (row,) = parsed('{"a":1.50,"a":2e400,"msg":"x"}')
    assert [(f["key"], f["raw"]) for f in row["fields"]] == [("a", "1.50"), ("a", "2e400")]


def test_predefined():
    (row,) = parsed('{"message":"late","msg":"best","level":"WARN","_x":1,"span":{"name":"main"},"ts":"2024-01-01T00:00:00Z"}')
    assert row["message"]["text"] == "best" and row["level"] == "warning" and row["logger"] == "main"
    assert [f["key"] for f in row["fields"]] == ["span"]
    (row,) = parsed('{"level":"odd","msg":"x"}')
    assert row["level"] is None and [f["key"] for f in row["fields"]] == ["level"]
    custom = merged(DEFAULTS, {"fields": {"predefined": {"level": {"variants": [{"names": ["lvl"], "values": {"error": ["bad"]}}]}}}})
    (row,) = parse_entry('{"lvl":"BAD"}', Predefined(custom))
    assert row["level"] == "error"


@pytest.mark.parametrize(
    "text, pairs",
    [
        ('a=1 b="x \\"y\\"" c=', [("a", "1"), ("b", 'x "y"'), ("c", "")]),
        ("  k.x-y_z=a:b/c  ", [("k.x-y_z", "a:b/c")]),
        ("a=b=c", None), ("word", None), ('a=b"c', None), ('a="open', None), ("a b=1", None),
    ],
)
def test_logfmt(text, pairs):
    (row,) = parsed(text)
    if pairs is None:
        assert row["parse_status"] == "invalid"
    else:
        assert [(f["key"], f["text"]) for f in row["fields"]] == pairs


def test_prefix_size_and_limit():
    (row,) = parsed('app | {"msg":"x"}', allow_prefix=True)
    assert row["prefix"] == "app | " and row["message"]["text"] == "x"
    assert parsed("x" * 20, max_size=10)[0]["parse_status"] == "oversized"
    assert parsed(" \r")[0]["parse_status"] == "empty"
    assert len(parsed('{"a":1}{"a":2}', limit=1)) == 1


@pytest.mark.parametrize(
    "text, query, expected",
    [
        ('{"some-value":1447015572184281088}', "some-value = 1447015572184281088", True),
        ('{"some-value":1447015572184281088}', "some-value = 1447015572184281089", False),
        ('{"some_Value":"x"}', "SOME-value = x", True),
        ('{"tag":"v1","tag":"v2"}', ".tag=v1", True), ('{"tag":"v1","tag":"v2"}', ".tag!=v1", True),
        ('{"x":1}', ".price?=3", True), ('{"x":1}', ".price=3", False), ('{"x":1}', ".price!=a", False),
        ('{"price":3,"price":4}', ".price?!=3", True),
        ('{"span":[{"name":"a"},{"name":"b"}]}', "span.[].name=a", True),
        ('{"span":[{"name":"a"},{"name":"b"}]}', "span.[0].name=b", False),
        ('{"span":[{"name":"a"},{"name":"b"}]}', "span.[1].name=b", True),
        ('{"mod.test":{"inner":42}}', "mod.test.inner=42", True),
        ('{"a":"abc"}', "a like a?c", True), ('{"a":"a_c"}', 'a like "a\\\\_c"', True), ('{"a":"abc"}', "a like ?c", False),
        ('{"a":"abc"}', "a != 3", False), ('{"a":"abc"}', "a not in (1,2)", True), ('{"a":"1.0"}', "a = 1", True),
        ('{"a":"5d"}', "a > 1", False), ('{"a":null}', "exists(a)", True), ('{"a":1}', "exists(.b)", False),
        ('{"level":"error"}', "level > info", True), ('{"level":"debug"}', "level > info", False), ('{"a":1}', "level != info", False),
        ('{"msg":"hello"}', "message ~= ell", True), ('{"logger":"x"}', "logger?=y", False),
        ('{"a":"b\\n"}', 'a ~~= "b$"', False), ('{"a":"bé"}', 'a ~~= "^b\\\\w$"', True),
    ],
)
def test_filters(spark, text, query, expected):
    rows = records(spark.createDataFrame([(0, "x", 0, text)], ENTRY), DEFAULTS)
    assert LogFrame.from_records(rows).where(query).df.count() == expected


def test_time_is_parsed_and_sorted_to_the_nanosecond(spark):
    lines = ['{"ts":"2024-01-25T19:10:20.000000002Z","msg":"b"}', '{"ts":"2024-01-25T20:10:20.000000001+01:00","msg":"a"}', '{"msg":"none"}']
    rows = records(spark.createDataFrame([(0, "x", i, t) for i, t in enumerate(lines)], ENTRY), DEFAULTS)
    assert [r.message.text for r in LogFrame.from_records(rows).sorted().collect()] == ["a", "b"]
    assert LogFrame.from_records(rows).tail(1).df.select(F.col("message.text")).first()[0] == "none"
