from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quarrylog.functions import strftime, timestamps
from quarrylog.functions.regexes import java_regex
from quarrylog.functions.suggest import suggest
from quarrylog.functions.timearg import parse_time
from quarrylog import settings
from quarrylog.levels import parse_level
from quarrylog.operators.visibility import is_empty, rules
from quarrylog.render import json_quoted, quoted_value


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1597994448", (1597994448, 0)), ("1597994448123", (1597994448, 123000000)), ("1597994448123456", (1597994448, 123456000)),
        ("1597994448123456789", (1597994448, 123456789)), ("-1.123456789", (-2, 876543211)), ("2020-08-21T07:20:48Z", (1597994448, 0)),
        ("2020-08-21 09:20:48.5+0200", (1597994448, 500000000)), ("2020-08-21 07:20:48.25", (1597994448, 250000000)),
        ("2020-08-21t09:50:48.1234567899-02:30", (1598012448, 123456789)), ("2020-8-21 7:20:48 UTC", (1597994448, 0)), ("2020-08-21 24:00:00", None), ("2020-02-30 10:00:00Z", None),
        ("17:00", None), ("2020-13-01T00:00:00Z", None), ("", None), ("abc", None),
    ],
)
def test_timestamps(spark, text, expected):
    got = spark.createDataFrame([(text,)], "r string").select(timestamps.parsed(F.col("r")).alias("t")).first().t
    assert (None if got is None else (got.sec, got.nsec)) == expected


def test_strftime(spark):
    row = spark.createDataFrame([(1597994448, 123456789)], "s long, n int")
    got = row.select(strftime.formatted("%Y-%m-%d %T.%3N %N %a %^b %-d %_m %e %j %U %V %G-%g %u%w %p %P %I %k %z %:z %s %% %F %R", timestamps.instant(F.col("s"), F.col("n")), F.col("n"), "Europe/Berlin")).first()[0]
    assert got == "2020-08-21 09:20:48.123 123456789 Fri AUG 21  8 21 234 33 34 2020-20 55 AM am 09  9 +0200 +02:00 1597994448 % 2020-08-21 09:20"


NOW = datetime(2024, 3, 14, 15, 9, 26, tzinfo=ZoneInfo("UTC"))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("-3h", "2024-03-14 12:09:26"), ("+1d", "2024-03-15 15:09:26"), ("-1h 30m", "2024-03-14 13:39:26"),
        ("2024-03-01", "2024-03-01 00:00:00"), ("2024-03-01T10:00:00+02:00", "2024-03-01 08:00:00"), ("today", "2024-03-14 00:00:00"),
        ("yesterday at 12:00", "2024-03-13 12:00:00"), ("friday", "2024-03-08 00:00:00"), ("3 hours ago", "2024-03-14 12:09:26"), ("Mar 01 10:20:30.000", "2024-03-01 10:20:30"),
        ("15 april", "2023-04-15 00:00:00"), ("3 mar 2022", "2022-03-03 00:00:00"), ("2027", "2027-01-01 00:00:00"),
    ],
)
def test_time_arguments(text, expected):
    assert str(parse_time(text, NOW, "%b %d %T.%3N").replace(tzinfo=None)) == expected


@pytest.mark.parametrize("text", ["3h", "nonsense", ""])
def test_no_time(text):
    with pytest.raises(ValueError):
        parse_time(text, NOW)


def test_regex_dialect():
    assert java_regex("(?P<a>x)$") == r"(?Ud)(?<a>x)\z"
    for bad in ("(?=x)", r"(x)\1", "(?<!y)"):
        with pytest.raises(ValueError):
            java_regex(bad)


def test_levels_and_suggestions():
    assert parse_level("WRN") == 1
    with pytest.raises(ValueError, match="warning"):
        parse_level("warnin")
    assert suggest("eror", ["error", "trace"]) == ["error"]


def test_visibility():
    tree = rules(["a.b", "!a.b.d"])
    assert not tree.shown(["a", "b", "c"]) and tree.shown(["a", "b", "d"]) and tree.shown(["a", "c"])
    only = rules(["!x"])
    assert only.shown(["X"]) and not only.shown(["y"])
    assert not rules(["*"]).shown(["q"]) and not rules(["a-*"]).shown(["a_b"])


def test_quoting():
    assert [quoted_value(x) for x in ("a", "", "a b", 'a"b', "12", "true", "a=b", "it's \"x\"", "tab\there")] == ["a", '""', '"a b"', "'a\"b'", '"12"', '"true"', '"a=b"', "`it's \"x\"`", "`tab\there`"]
    assert json_quoted("a\x7f\n") == '"a\\u007f\\n"'
    assert is_empty("object", "{ }") and not is_empty("number", "0")


def test_layers_and_marks(tmp_path):
    (tmp_path / "etc/quarrylog").mkdir(parents=True)
    (tmp_path / ".config/quarrylog").mkdir(parents=True)
    (tmp_path / "etc/quarrylog/config.toml").write_text('time-zone = "Asia/Tokyo"\n[formatting.punctuation]\nfield-key-value-separator = ":"\n')
    (tmp_path / ".config/quarrylog/config.json").write_text('{"formatting": {"punctuation": {"message-delimiter": {"ascii": "~"}}}}')
    found = settings.layers({"QUARRYLOG_CONFIG": "own.toml"}, tmp_path, tmp_path / "etc")
    assert [x.rsplit("/", 1)[-1] for x in found] == ["config.toml", "config.json", "own.toml"]
    conf = settings.load(*found[:2])
    marks = settings.marks(conf, False)
    assert conf["time-zone"] == "Asia/Tokyo" and marks["field-key-value-separator"] == ":" and marks["message-delimiter"] == "~" and marks["array-separator"] == " "
    assert settings.marks(conf, True)["message-delimiter"] == settings.PUNCTUATION["message-delimiter"][1]
