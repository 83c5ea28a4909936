"""Records to human-readable lines: time, level, logger, message, fields, caller.

The time is an expression (``strftime``); quoting, nesting and expansion follow
each value's content, so the line itself is made in Python, in Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.strftime import formatted
from .operators.records import json_value
from .operators.visibility import Visibility, is_empty
from .settings import PUNCTUATION, marks

# Level labels, and the one for a level that isn't known.
LABELS = {"error": "ERR", "warning": "WRN", "info": "INF", "debug": "DBG", "trace": "TRC"}
UNKNOWN_LEVEL = "###"
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\Z")
_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def json_quoted(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " or c == "\x7f" else c) for c in text) + '"'


def trimmed(text: str) -> str:
    """Without ASCII white space at the end, unless there is nothing else."""
    return text.rstrip(" \t\r\n\x0b\x0c") or text


def quoted_value(text: str) -> str:
    """A string as a field's value: plain if that can't be taken for anything else, then the first quotes that fit."""
    if not text:
        return '""'
    text = trimmed(text)
    hard = _CONTROL.search(text)
    plain = not hard and not re.search(r"[\"'\\` =]", text)
    if plain and text[0] not in "{[" and text not in ("true", "false", "null") and not (_NUMBER.match(text) and len(text) <= 39):
        return text
    if not hard and "\\" not in text:
        for quote in "\"'":
            if quote not in text:
                return quote + text + quote
    if "`" not in text and not re.search(r"[\x00-\x08\x0b-\x1f\x7f]", text) and text.strip():
        return f"`{text}`"
    return json_quoted(text)


def quoted_message(text: str, style: str, delimiter: str) -> str:
    """A message by style; ``delimited`` puts a rare delimiter between it and fields instead of quotes."""
    text = trimmed(text)
    if style == "raw":
        return text
    if style == "always-double-quoted":
        return json_quoted(text)
    if not text:
        return '""' if style == "always-quoted" else ""
    hard = _CONTROL.search(text)
    if style == "delimited":
        if not hard and text[0] not in "\"'`" and delimiter not in text:
            return text
    elif style == "auto-quoted" and not hard and "=" not in text and text[0] not in "\"'`[{" and not re.search(r"\S=", text):
        return text
    if not hard:
        for quote in "\"'`":
            if quote not in text:
                return quote + text + quote
    return json_quoted(text)


class Renderer:
    def __init__(self, settings: dict, visibility: Visibility | None = None, hide_empty: bool = False, raw_fields: bool = False, unicode: bool = True):
        formatting = settings["formatting"]
        self.flatten = formatting["flatten"] == "always"
        self.pretty = formatting["prettify-field-keys"]
        self.style = formatting["message"]["format"]
        self.expansion = formatting["expansion"]["mode"]
        self.marks = marks(settings, unicode)
        self.show_level = settings["fields"]["predefined"]["level"].get("show", "auto") == "always"
        self.visibility, self.hide_empty, self.raw_fields = visibility or Visibility(), hide_empty, raw_fields
        self.predefined_nested = {n for kind, spec in settings["fields"]["predefined"].items() for n in ([x for v in spec["variants"] for x in v["names"]] if kind == "level" else spec["names"]) if "." in n}

    def key(self, key: str) -> str:
        return key.replace("_", "-") if self.pretty else key

    def value(self, kind: str, raw: str, text: str) -> str:
        if self.raw_fields:
            return raw
        if kind == "string":
            return quoted_value(text) if raw.startswith('"') or not self._auto(text) else text
        if kind == "object":
            inner = [f"{self.key(k)}{self.marks['field-key-value-separator']}{self.value(kd, r, t)}" for k, kd, r, t, _ in json_value(raw, 0)[2]]
            return f"{{ {' '.join(inner)} }}" if inner else "{}"
        if kind == "array":
            return "[" + self.marks["array-separator"].join(self.value(k, json_quoted(t) if k == "string" else t, t) for k, t, _ in json_value(raw, 0)[2]) + "]"
        return text

    @staticmethod
    def _auto(text: str) -> bool:
        """Whether an unquoted text stands for a number, a Boolean or null."""
        return text in ("true", "false", "null") or bool(_NUMBER.match(text)) and len(text) <= 39

    def leaves(self, path: list[str], kind: str, raw: str, text: str, hidden: list) -> list[tuple[str, str]]:
        """(key, value) pairs to show of one field, flattened if asked; ``hidden`` gets a mark for each that isn't shown."""
        name = ".".join(path)
        if self.hide_empty and is_empty(kind, text) or name in self.predefined_nested and len(path) > 1:
            return []
        if kind == "object" and (self.flatten or self.hide_empty or self.visibility.children or self.visibility.patterns):
            inner = json_value(raw, 0)[2]
            if inner:
                out = [x for k, kd, r, t, _ in inner for x in self.leaves([*path, k], kd, r, t, hidden)]
                if self.flatten or len(path) > 1:
                    return out
                own = " ".join(f"{k[len(self.key(name)) + 1 :]}{self.marks['field-key-value-separator']}{v}" for k, v in out)
                return [(self.key(name), f"{{ {own} }}")] if out else []
        if not self.visibility.shown(name.split(".")):
            hidden.append(name)
            return []
        return [(self.key(name), self.value(kind, raw, text))]

    def line(self, row: dict, time: str | None) -> str:
        """One record; ``time`` is its formatted time, spaces if it has none, None to leave it out."""
        parts, marks = [], self.marks
        if time is not None:
            parts.append(time)
        if row["level"] or self.show_level:
            parts.append(f"{marks['level-left-separator']}{LABELS.get(row['level'], UNKNOWN_LEVEL)}{marks['level-right-separator']}")
        if row["logger"]:
            parts.append(row["logger"] + marks["logger-name-separator"])
        hidden: list = []
        fields = [x for f in row["fields"] or [] for x in self.leaves([f["key"]], f["kind"], f["raw"], f["text"], hidden)]
        message = row["message"]
        if message:
            text = quoted_message(message["text"], self.style, marks["message-delimiter"]) if message["kind"] == "string" else self.value(message["kind"], message["raw"], message["text"])
            if text:
                parts.append(text)
                if self.style == "delimited" and fields:
                    parts.append(marks["message-delimiter"])
        expanded = []
        for key, value in fields:
            if self.expansion == "always" or self.expansion == "auto" and value[:1] == "`" and "\n" in value:
                expanded.append(self.block(key, value))
            else:
                parts.append(key + marks["field-key-value-separator"] + (value if self.expansion != "never" or value[:1] != "`" else json_quoted(value[1:-1])))
        if hidden:
            parts.append(marks["hidden-fields-indicator"])
        if caller := self.caller(row["caller"]):
            parts.append(marks["source-location-separator"] + caller)
        return "\n".join([" ".join(parts), *expanded])

    def block(self, key: str, value: str) -> str:
        """A field on its own lines."""
        if value[:1] == "`" and "\n" in value:
            return f"  > {key}{self.marks['field-key-value-separator']}" + "".join("\n    | " + x for x in value[1:-1].split("\n"))
        return f"  > {key}{self.marks['field-key-value-separator']}{value}"

    def caller(self, caller: dict | None) -> str:
        if not caller:
            return ""
        place = ":".join(x for x in (caller["file"], caller["line"]) if x)
        if caller["name"] and place:
            return caller["name"] + self.marks["caller-name-file-separator"] + place
        return caller["name"] or place


def badge(name: Column, input_id: Column, style: str = "minimal") -> Column:
    """What stands before a line to tell its input."""
    number = F.concat(F.lit("#"), (input_id).cast("string"))
    shown = {"minimal": number, "compact": F.concat(number, F.lit(" "), F.regexp_extract(name, r"([^/]*)\z", 1)), "full": F.concat(number, F.lit(" "), name)}[style]
    return F.concat(shown, F.lit(PUNCTUATION["input-right-separator"][1]))


#: What a rendered record keeps to be ordered by.
PLACE = ["input_id", "input_name", "offset", "rec_no", "ts_sec", "ts_nsec"]


def rendered(records: DataFrame, settings: dict, renderer: Renderer, raw: bool = False, passthrough: bool = True, input_info: str | None = None) -> DataFrame:
    """The places and times of ``records`` with ``line``: the rendered record, or its source text if ``raw`` or if it was never parsed and ``passthrough`` holds."""
    time = formatted(settings["time-format"], F.col("ts"), F.col("ts_nsec"), settings["time-zone"])
    source = F.col("raw").substr(F.col("rec_start") + 1, F.col("rec_end") - F.col("rec_start"))
    unparsed = F.col("parse_status") != "ok"
    rows = records.where(~unparsed | F.lit(passthrough) & (F.col("parse_status") != "empty"))
    if raw:
        out = rows.select(*PLACE, source.alias("line"))
    else:
        schema = rows.select(*PLACE, F.lit("").alias("line")).schema
        timed = rows.withColumns({"__time": time, "__source": source})

        def run(batches):
            arrow = None
            for batch in batches:
                lines = []
                for row in batch.to_pylist():
                    lines.append(row["__source"] if row["parse_status"] != "ok" else row["prefix"] + renderer.line(row, row["__time"] if row["__time"] is not None else "-" * 12))
                from pyspark.sql.pandas.types import to_arrow_schema

                arrow = arrow or to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).cast(arrow.field(n).type) for n in PLACE), pc.cast(pa.array(lines, pa.string()), pa.string())], schema=arrow)

        out = timed.mapInArrow(run, schema)
    if input_info:
        out = out.withColumn("line", F.concat(badge(F.col("input_name"), F.col("input_id"), input_info), "line"))
    return out


