"""Entries to records, exactly: JSON object streams and logfmt, predefined fields, and the flattened search view.

Built-in JSON functions lose number texts, duplicate keys and what follows the
first object, so this is Python, in Arrow batches; everything after it is
expressions on its columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import timestamps
from ..functions.keys import normal, wildcard_regex
from ..levels import RANK
from ..settings import level_words

FIELD = "struct<key: string, kind: string, raw: string, text: string>"
ENTRY = "input_id int, input_name string, offset bigint, raw string"
RECORD = (
    f"{ENTRY}, rec_no int, rec_start int, rec_end int, prefix string, parse_status string, ts_raw string, level string, level_rank int, logger string, "
    f"caller struct<name: string, file: string, line: string>, message struct<kind: string, raw: string, text: string>, "
    f"fields array<{FIELD}>, predefined array<{FIELD}>, nodes array<struct<path: string, kind: string, text: string>>"
)
#: Original predefined pairs that a record remembers for search.
MAX_PREDEFINED = 8

_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}
# Characters that a logfmt key may not hold, besides all up to the space.
_KEY = re.compile(r"[^\x00-\x20\"'(),;<=>\[\\\]^`{|}\x7f]+")
_PLAIN = re.compile(r"[^\x00-\x20]*")


#: A pair whose value is no container, and what follows it.
_PAIR = re.compile(r'[ \t\r\n]*"((?:[^"\\\x00-\x1f]|\\.)*)"[ \t\r\n]*:[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)[ \t\r\n]*([,}])')
_KINDS = {'"': "string", "t": "boolean", "f": "boolean", "n": "null"}


class Malformed(ValueError):
    pass


def json_value(s: str, at: int) -> tuple[str, str, object, int]:
    """kind, decoded text (raw text unless a string), children, end of the value at ``at``."""
    c = s[at : at + 1]
    if c == '"':
        try:
            text, end = scanstring(s, at + 1, True)
        except ValueError as e:
            raise Malformed(str(e)) from None
        return "string", text, None, end
    if c == "{":
        pairs, end = json_pairs(s, at, False)
        return "object", s[at:end], pairs, end
    if c == "[":
        items, i = [], _SPACE.match(s, at + 1).end()
        if s[i : i + 1] == "]":
            return "array", s[at : i + 1], items, i + 1
        while True:
            kind, text, inner, end = json_value(s, i)
            items.append((kind, text, inner))
            i = _SPACE.match(s, end).end()
            if s[i : i + 1] == "]":
                return "array", s[at : i + 1], items, i + 1
            if s[i : i + 1] != ",":
                raise Malformed("array")
            i = _SPACE.match(s, i + 1).end()
    if c in _WORDS and s.startswith(_WORDS[c][0], at):
        word, kind = _WORDS[c]
        return kind, word, None, at + len(word)
    m = _NUMBER.match(s, at)
    if not m:
        raise Malformed("value")
    return "number", m[0], None, m.end()


def json_pairs(s: str, at: int, root: bool) -> tuple[list, int]:
    """(key, kind, raw, text, children) of the object at ``at`` in order, duplicates kept, and its end."""
    out, i = [], _SPACE.match(s, at + 1).end()
    if s[i : i + 1] == "}":
        return out, i + 1
    while True:
        # most pairs are found at once; what isn't is looked at piece by piece
        m = _PAIR.match(s, i)
        if m and "\\" not in m[1]:
            key, raw, after = m.groups()
            kind = _KINDS.get(raw[0], "number")
            text = raw
            if kind == "string":
                try:
                    text = scanstring(raw, 1, True)[0] if "\\" in raw else raw[1:-1]
                except ValueError as e:
                    raise Malformed(str(e)) from None
            out.append((key, kind, raw, text, None))
            i = m.end()
            if after == "}":
                return out, i
            i = _SPACE.match(s, i).end()
            continue
        if s[i : i + 1] != '"':
            raise Malformed("key")
        try:
            key, end = scanstring(s, i + 1, True)
        except ValueError as e:
            raise Malformed(str(e)) from None
        if root and "\\" in s[i:end]:
            raise Malformed("a root key with an escape")
        i = _SPACE.match(s, end).end()
        if s[i : i + 1] != ":":
            raise Malformed("colon")
        i = _SPACE.match(s, i + 1).end()
        kind, text, inner, end = json_value(s, i)
        out.append((key, kind, s[i:end], text, inner))
        i = _SPACE.match(s, end).end()
        if s[i : i + 1] == "}":
            return out, i + 1
        if s[i : i + 1] != ",":
            raise Malformed("comma")
        i = _SPACE.match(s, i + 1).end()


def logfmt_pairs(s: str) -> list:
    """Pairs of a logfmt line; one fault makes the whole line invalid."""
    out, i, n = [], 0, len(s)
    while True:
        while i < n and s[i] <= " ":
            i += 1
        if i == n:
            return out
        m = _KEY.match(s, i)
        if not m or s[m.end() : m.end() + 1] != "=":
            raise Malformed("key")
        key, i = m[0], m.end() + 1
        if s[i : i + 1] == '"':
            try:
                text, end = scanstring(s, i + 1, False)
            except ValueError as e:
                raise Malformed(str(e)) from None
            if end < n and s[end] > " ":
                raise Malformed("space after a quoted value")
        else:
            end = _PLAIN.match(s, i).end()
            text = s[i:end]
            if '"' in text or "=" in text:
                raise Malformed("a value with a quote or equals sign")
        out.append((key, "string", s[i:end], text, None))
        i = end


_normal = lru_cache(10_000)(normal)


def flattened(pairs: list) -> list[tuple[str, str, str]]:
    """(path, kind, text) of every value and container; within nested objects the first of equal keys counts."""
    out = []

    def walk(path, kind, text, inner):
        out.append((path, kind, text))
        if kind == "object":
            met = set()
            for key, k, _, t, more in inner:
                key = _normal(key)
                if key not in met:
                    met.add(key)
                    walk(f"{path}.{key}", k, t, more)
        elif kind == "array":
            for n, (k, t, more) in enumerate(inner):
                walk(f"{path}.[{n}]", k, t, more)

    for key, kind, _, text, inner in pairs:
        if inner is None:
            out.append((_normal(key), kind, text))
        else:
            walk(_normal(key), kind, text, inner)
    return out


class Predefined:
    """Which names are predefined fields, and how good each is; the least number wins, the later among equals."""

    def __init__(self, settings: dict):
        fields = settings["fields"]
        self.names: dict[str, tuple[str, int, dict | None]] = {}
        for kind, spec in fields["predefined"].items():
            if kind != "level":
                for i, name in enumerate(spec["names"]):
                    self.names.setdefault(name, (kind, i, None))
        i = 0
        for variant in fields["predefined"]["level"]["variants"]:
            words = level_words(variant)
            for name in variant["names"]:
                self.names.setdefault(name, ("level", i, words | {None: variant.get("default")}))
                i += 1
        self.dotted = {n for n in self.names if "." in n}
        self.ignored = re.compile("|".join(wildcard_regex(x) for x in fields["ignore"])) if fields["ignore"] else None

    def take(self, kind: str, vkind: str, raw: str, text: str, words: dict | None) -> tuple[bool, object]:
        """Whether the value fills the field, and with what."""
        if kind == "time":
            stamp = text.strip('"')
            return bool(stamp), stamp
        if kind == "level":
            level = words.get(text, words[None])
            return text in words, level
        if kind == "message":
            return True, (vkind, raw, text)
        if kind in ("logger", "caller", "caller-file"):
            borrowed = vkind == "string" and "\\" not in raw
            return True, (text or None) if borrowed else None
        return vkind == "number" or bool(text), text

    def resolve(self, pairs: list) -> tuple[dict, list, list]:
        """The predefined values, the pairs that stay fields, and the pairs that were predefined."""
        found, best, fields, original = {}, {}, [], []

        def offer(name, vkind, raw, text) -> bool:
            kind, priority, words = self.names[name]
            if priority > best.get(kind, 1 << 30):
                return False
            ok, value = self.take(kind, vkind, raw, text, words)
            if ok or value is not None:
                best[kind], found[kind] = priority, value
            if ok and len(original) < MAX_PREDEFINED:
                original.append((name, vkind, raw, text))
            return ok

        def nested(prefix, inner):
            for key, vkind, raw, text, more in inner:
                name = f"{prefix}.{key}"
                if name in self.dotted:
                    offer(name, vkind, raw, text)
                elif vkind == "object":
                    nested(name, more)

        for key, vkind, raw, text, inner in pairs:
            if key in self.names and offer(key, vkind, raw, text):
                continue
            if key not in self.names and self.ignored and self.ignored.match(key):
                continue
            if vkind == "object" and any(n.startswith(key + ".") for n in self.dotted):
                nested(key, inner)
            fields.append((key, vkind, raw, text, inner))
        return found, fields, original


def scan_entry(raw: str, predefined: Predefined, input_format: str = "auto", allow_prefix: bool = False, limit: int | None = None, max_size: int | None = None) -> Iterator[tuple]:
    """(start, end, status, prefix, resolved) of an entry's records, then of what is left of it where parsing stopped (status ``invalid``)."""
    if max_size is not None and len(raw) > max_size // 4 and len(raw.encode()) > max_size:
        yield 0, len(raw), "oversized", None, None
        return
    if not raw.strip(" \t\r\n"):
        yield 0, len(raw), "empty", None, None
        return
    at, prefix = 0, ""
    if allow_prefix and raw.rstrip().endswith("}") and "{" in raw:
        at = raw.index("{")
        prefix = raw[:at]
    n, end = 0, len(raw)
    is_json = input_format == "json" or input_format == "auto" and raw[_SPACE.match(raw, at).end() :][:1] == "{"
    try:
        if not is_json:
            yield at, end, "ok", prefix, predefined.resolve(logfmt_pairs(raw[at:]))
            return
        while True:
            at = _SPACE.match(raw, at).end()
            if at >= end or limit is not None and n >= limit:
                return
            if raw[at] != "{":
                raise Malformed("object")
            pairs, stop = json_pairs(raw, at, True)
            yield at, stop, "ok", prefix if n == 0 else "", predefined.resolve(pairs)
            at, n = stop, n + 1
    except (Malformed, RecursionError):
        yield at, end, "invalid", None, None


def nodes_of(fields: list, original: list) -> list[tuple[str, str, str]]:
    return flattened([*fields, *((*p, json_value(p[2], 0)[2] if p[1] in ("object", "array") else None) for p in original)])


def parse_entry(raw: str, predefined: Predefined, **options) -> Iterator[dict]:
    """The records of one entry by column name."""
    named = lambda names, rows: [dict(zip(names, x, strict=False)) for x in rows]
    for start, end, status, prefix, resolved in scan_entry(raw, predefined, **options):
        row = {"rec_start": start, "rec_end": end, "parse_status": status}
        if resolved:
            found, fields, original = resolved
            level, message = found.get("level"), found.get("message")
            caller = {"name": found.get("caller"), "file": found.get("caller-file"), "line": found.get("caller-line")}
            shown = ("key", "kind", "raw", "text")
            row |= {
                "prefix": prefix, "ts_raw": found.get("time"), "level": level, "level_rank": RANK.get(level), "logger": found.get("logger"),
                "caller": caller if any(caller.values()) else None, "message": dict(zip(("kind", "raw", "text"), message, strict=True)) if message else None,
                "fields": named(shown, fields), "predefined": named(shown, original), "nodes": named(("path", "kind", "text"), nodes_of(fields, original)),
            }
        yield row


class Structs:
    """A column of lists of structs, or of structs that may be null, as flat lists."""

    def __init__(self, kind: pa.DataType):
        self.many = pa.types.is_list(kind)
        self.kind, self.ends, self.valid = kind.value_type if self.many else kind, [0], []
        self.flat: list[tuple] = []

    def add(self, rows: list[tuple] | None) -> None:
        self.valid.append(rows is not None)
        if rows:
            self.flat += rows
        elif not self.many:
            self.flat.append((None,) * self.kind.num_fields)
        self.ends.append(len(self.flat))

    def array(self) -> pa.Array:
        n = self.kind.num_fields
        columns = list(zip(*self.flat, strict=True)) if self.flat else [()] * n
        none = pa.array([not x for x in self.valid], pa.bool_())
        parts = [pa.array(columns[i], self.kind.field(i).type) for i in range(n)]
        if not self.many:
            return pa.StructArray.from_arrays(parts, fields=list(self.kind), mask=none)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(self.kind)), mask=none)


def records(entries: DataFrame, settings: dict, **options) -> DataFrame:
    """RECORD rows of ENTRY rows, then the parsed time: ts, ts_sec, ts_nsec and ts_offset_min."""
    schema = _parse_datatype_string(RECORD)

    def run(batches):
        arrow, predefined = to_arrow_schema(schema), Predefined(settings)
        plain = ["rec_no", "rec_start", "rec_end", "prefix", "parse_status", "ts_raw", "level", "level_rank", "logger"]
        nested = ["caller", "message", "fields", "predefined", "nodes"]
        for batch in batches:
            rows, source = [], []
            made = {name: Structs(arrow.field(name).type) for name in nested}
            caller, message, shown, original_, nodes = (made[x].add for x in nested)
            for k, raw in enumerate(batch.column(3).to_pylist()):
                for n, (start, end, status, prefix, resolved) in enumerate(scan_entry(raw or "", predefined, **options)):
                    source.append(k)
                    if resolved is None:
                        rows.append((n, start, end, prefix, status, None, None, None, None))
                        for x in made.values():
                            x.add(None)
                        continue
                    found, fields, original = resolved
                    get = found.get
                    level, said = get("level"), get("message")
                    rows.append((n, start, end, prefix, status, get("time"), level, RANK.get(level), get("logger")))
                    by = (get("caller"), get("caller-file"), get("caller-line"))
                    caller([by] if any(by) else None)
                    message([said] if said else None)
                    shown([p[:4] for p in fields])
                    original_(original)
                    nodes(nodes_of(fields, original))
            columns = dict(zip(plain, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(plain, [])
            own = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(columns[x], arrow.field(x).type) for x in plain), *(x.array() for x in made.values())], schema=arrow)

    made = entries.select("input_id", "input_name", "offset", "raw").mapInArrow(run, schema)
    made = made.withColumn("__t", timestamps.parsed(F.col("ts_raw")))
    return made.withColumns({"ts_sec": F.col("__t.sec"), "ts_nsec": F.col("__t.nsec"), "ts_offset_min": F.col("__t.offset_min")}).withColumn("ts", timestamps.instant(F.col("ts_sec"), F.col("ts_nsec"))).drop("__t")
