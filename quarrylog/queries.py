"""The engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .frame import LogFrame
from .functions import strftime, timestamps
from .levels import parse_level
from .operators import index
from .operators.records import records
from .operators.visibility import rules
from .plans.filters import Selection, membership
from .render import Renderer, rendered
from .settings import DEFAULTS
from .sources import text

#: How event types stand for severity: a level variant as a configuration would name it.
EVENT_LEVELS = {"error": "error", "purchase": "warning", "signup": "info", "click": "debug", "view": "trace"}
PRIORITY_LEVELS = {"1-URGENT": "error", "2-HIGH": "warning", "3-MEDIUM": "info", "4-NOT SPECIFIED": "debug", "5-LOW": "trace"}
RANK_SQL = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 END"
FLAG_SQL = "CASE event_type WHEN 'error' THEN 8 WHEN 'purchase' THEN 32 WHEN 'signup' THEN 256 WHEN 'click' THEN 4096 WHEN 'view' THEN 16384 END"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> LogFrame:
    return LogFrame.from_table(table(spark, sf_dir, "events"), ("event_id",), "ts", ("event_type", EVENT_LEVELS), message="event_type", json=("props",))


QUERIES, SQL = {}, {}


def _add(name, function, sql):
    QUERIES[name], SQL[name] = function, sql


def _event_query(name, query, condition):
    _add(name, lambda s, d: events(s, d).where(query).df.select("event_id", "event_type", "value"), f"SELECT event_id, event_type, value FROM events WHERE {condition}")


def _event_selection(name, selection, condition):
    _add(name, lambda s, d: events(s, d).where(selection).df.select("event_id", "event_type", "value"), f"SELECT event_id, event_type, value FROM events WHERE {condition}")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_event_selection("level_ge_warning", Selection(level="warning"), f"{RANK_SQL} <= 1")
_event_query("level_cmp_gt_info", "level > info", f"{RANK_SQL} < 2")
_event_query("level_eq", "level = debug", f"{RANK_SQL} = 3")
_event_query("level_ne", "level != error", f"{RANK_SQL} <> 0")
_event_selection("since_until", Selection(since=datetime(2024, 1, 5), until=datetime(2024, 1, 12, 12)), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
_event_selection("field_exact", Selection(fields=["event-type=click"]), "event_type = 'click'")
_event_selection("field_not_exact", Selection(fields=["event_type!=click"]), "event_type <> 'click'")
_event_query("field_substring", "event-type ~= ur", "contains(event_type, 'ur')")
_event_query("field_not_substring", "event-type not contains ur", "NOT contains(event_type, 'ur')")
_event_query("field_regex", 'event-type ~~= "^(?P<first>[ce]).*[rk]$"', "regexp_matches(event_type, '^[ce].*[rk]$')")
_event_query("field_in", "event-type in (click, view)", "event_type IN ('click', 'view')")
_event_query("field_not_in", "event-type not in (click, view)", "event_type NOT IN ('click', 'view')")
for _name, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _event_query(f"num_{_name}", f"user-id {_op} 50", f"user_id {_op.replace('!=', '<>')} 50")
_event_query("num_float_gt", "value > 12.5", "value > 12.5")
_event_query("num_in", "user-id in (1, 2, 3, 500)", "user_id IN (1, 2, 3, 500)")
_event_query("nested_json_num", ".props.k >= 50", f"{K} >= 50")
_event_query("exists_field", "exists(.props.k) and level >= warning", f"json_extract_string(props, '$.k') IS NOT NULL AND {RANK_SQL} <= 1")
_event_query("not_exists", "not exists(.props.nothing) and value < 5", "value < 5")
_event_query("bool_precedence", "level = error or level = info and value > 20 or user-id = 7", f"{RANK_SQL} = 0 OR {RANK_SQL} = 2 AND value > 20 OR user_id = 7")
_event_query("not_group", "not (level >= warning or .props.k < 30) && !(user-id > 800)", f"NOT ({RANK_SQL} <= 1 OR {K} < 30) AND NOT user_id > 800")
_event_query("key_normalization", "EVENT_type = signup and User-ID >= 100", "event_type = 'signup' AND user_id >= 100")
_event_query("message_key", "msg like *up", "event_type LIKE '%up'")

_add(
    "field_like",
    lambda s, d: LogFrame.from_table(table(s, d, "part"), ("p_partkey",)).where("p-name like *e?* and p-brand not like *#1?").df.select("p_partkey", "p_name", "p_brand"),
    "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE '%e_%' AND NOT p_brand LIKE '%#1_'",
)
_add(
    "field_in_file",
    lambda s, d: LogFrame.from_table(table(s, d, "nation"), ("n_nationkey",)).where("n-name in @wanted", read_set=lambda _: [r.n_name for r in table(s, d, "nation").where("n_regionkey = 1").collect()]).df.select("n_nationkey", "n_name"),
    "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
)


def _sparse(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user"))
    return LogFrame.from_table(df, ("event_id",))


SPARSE = "WITH s AS (SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN user_id % 3 <> 0 THEN user_id END AS \"user\" FROM events)"
for _name, _query, _condition in [
    ("include_absent", "kind ?= click", "kind IS NULL OR kind = 'click'"),
    ("include_absent_num", "user ?> 500", '"user" IS NULL OR "user" > 500'),
    ("include_absent_negated", "kind ?!= click", "kind IS NULL OR kind <> 'click'"),
    ("negate_missing", "kind != click", "kind <> 'click'"),
    ("exists_sparse", "exists(kind) and not exists(.user)", 'kind IS NOT NULL AND "user" IS NULL'),
]:
    _add(_name, lambda s, d, q=_query: _sparse(s, d).where(q).df.select("event_id", "kind", "user"), f"{SPARSE} SELECT event_id, kind, \"user\" FROM s WHERE {_condition}")

_vectors = lambda s, d: LogFrame.from_table(table(s, d, "embeddings"), ("vec_id",))
_add("array_any", lambda s, d: _vectors(s, d).where("embedding.[] > 0.3").df.select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.3)) > 0")
_add("array_index", lambda s, d: _vectors(s, d).where("embedding.[3] > 0.1").df.select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE CAST(embedding[4] AS DOUBLE) > 0.1")


def _sort_chronological(s, d):
    return events(s, d).where("value >= 0").sorted().select("event_id", "ts", "event_type")


_add("sort_chronological", _sort_chronological, "SELECT event_id, ts, event_type FROM events WHERE value >= 0 AND ts IS NOT NULL ORDER BY ts, event_id")


def _dated(s, d):
    orders = table(s, d, "orders").select(F.lit(0).alias("input_id"), F.col("o_orderkey").alias("key"), F.lit(0).alias("line"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority"))
    lines = table(s, d, "lineitem").select(F.lit(1).alias("input_id"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ts"), F.lit(None).cast("string").alias("priority"))
    return LogFrame.from_table(orders.unionByName(lines), ("input_id", "key", "line"), "ts", ("priority", PRIORITY_LEVELS), source="input_id")


DATED = """WITH u AS (SELECT 0 AS input_id, o_orderkey AS key, 0 AS line, o_orderdate AS ts, o_orderpriority AS priority FROM orders
UNION ALL SELECT 1, l_orderkey, l_linenumber, l_shipdate, NULL FROM lineitem)"""
_add("concat_inputs", lambda s, d: _dated(s, d).df.select("input_id", "key", "line", "ts"), f"{DATED} SELECT input_id, key, line, ts FROM u")
_add(
    "sort_multi_input",
    lambda s, d: _dated(s, d).where(Selection(since=datetime(1995, 1, 1), until=datetime(1996, 1, 1))).sorted().select("input_id", "key", "line", "ts"),
    f"{DATED} SELECT input_id, key, line, ts FROM u WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' ORDER BY ts, input_id, key, line",
)
_add(
    "level_from_priority",
    lambda s, d: _dated(s, d).where("level >= warning").df.groupBy("priority").agg(F.count(F.lit(1)).alias("n")),
    f"{DATED} SELECT priority, count(*) AS n FROM u WHERE priority IN ('1-URGENT', '2-HIGH') GROUP BY priority",
)
_add(
    "tail_n_per_input",
    lambda s, d: LogFrame.from_table(table(s, d, "conversations"), ("conv_id", "turn"), source="conv_id").tail(2).df.select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
)


def _blocks(s, d):
    frame = events(s, d)
    df = frame.df.withColumn("block_no", F.expr("event_id div 1000"))
    return df.withColumn("rank", frame.resolver.rank)


def _stats(s, d):
    return index.block_stats(_blocks(s, d), ["block_no"], rank=F.col("rank"))


STATS = f"""WITH b AS (SELECT event_id // 1000 AS block_no, count(*) AS entries_valid, CAST(0 AS BIGINT) AS entries_invalid, min(ts) AS ts_min, max(ts) AS ts_max,
bit_or(CAST({FLAG_SQL} AS BIGINT) | 131072) AS flags FROM events GROUP BY 1)"""
_add("block_stats", _stats, f"{STATS} SELECT * FROM b")
_add(
    "file_stats",
    lambda s, d: index.merged_stats(_stats(s, d).withColumn("input_id", F.lit(0)), ["input_id"]),
    f"{STATS} SELECT 0 AS input_id, CAST(sum(entries_valid) AS BIGINT) AS entries_valid, CAST(sum(entries_invalid) AS BIGINT) AS entries_invalid, min(ts_min) AS ts_min, max(ts_max) AS ts_max, bit_or(flags) AS flags FROM b",
)
_add("block_prune_time", lambda s, d: _stats(s, d).where(index.possible(datetime(2024, 1, 10), datetime(2024, 1, 12))).select("block_no"), f"{STATS} SELECT block_no FROM b WHERE ts_max >= TIMESTAMP '2024-01-10' AND ts_min <= TIMESTAMP '2024-01-12'")
_add("block_prune_level", lambda s, d: _stats(s, d).where(index.possible(rank=parse_level("warning"))).select("block_no"), f"{STATS} SELECT block_no FROM b WHERE flags & 40 <> 0")


def _shuffled(s, d):
    """Events in another order within each block, some without a time."""
    return _blocks(s, d).select("block_no", F.expr("(event_id * 7919) % 1000").alias("line"), "event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))


SHUFFLED = "WITH e AS (SELECT event_id // 1000 AS block_no, (event_id * 7919) % 1000 AS line, event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events)"
_order = ["line", "event_id"]
_add(
    "block_sortedness",
    lambda s, d: index.with_previous(_shuffled(s, d), ["block_no"], _order).select("event_id", "unsorted"),
    f"""{SHUFFLED} SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN false WHEN ts IS NULL THEN lag(ts) OVER w IS NOT NULL ELSE coalesce(ts < lag(ts) OVER w, false) END AS unsorted
FROM e WINDOW w AS (PARTITION BY block_no ORDER BY line, event_id)""",
)
_add(
    "ts_fill_one_step",
    lambda s, d: index.with_previous(_shuffled(s, d), ["block_no"], _order).select("event_id", "ts_fill"),
    f"{SHUFFLED} SELECT event_id, coalesce(ts, lag(ts) OVER (PARTITION BY block_no ORDER BY line, event_id)) AS ts_fill FROM e",
)
_add(
    "chronology_rank",
    lambda s, d: index.chronology(index.with_previous(_shuffled(s, d), ["block_no"], _order), ["block_no"], _order).select("event_id", "chrono"),
    f"""{SHUFFLED}, f AS (SELECT *, coalesce(ts, lag(ts) OVER (PARTITION BY block_no ORDER BY line, event_id)) AS ts_fill FROM e)
SELECT event_id, CAST(row_number() OVER (PARTITION BY block_no ORDER BY ts_fill NULLS FIRST, line, event_id) AS INTEGER) AS chrono FROM f""",
)
_add(
    "interval_overlap",
    lambda s, d: _overlap(s, d),
    f"{STATS}, p AS (SELECT a.block_no AS a, c.block_no AS c, a.ts_min AS al, a.ts_max AS ah, c.ts_min AS cl, c.ts_max AS ch FROM b a JOIN b c ON c.block_no = a.block_no + 1) SELECT a AS block_no, c AS other_no, cl BETWEEN al AND ah OR ch BETWEEN al AND ah AS overlaps FROM p",
)


def _overlap(s, d):
    a = _stats(s, d).select("block_no", F.col("ts_min").alias("al"), F.col("ts_max").alias("ah"))
    c = _stats(s, d).select(F.col("block_no").alias("other_no"), F.col("ts_min").alias("cl"), F.col("ts_max").alias("ch"))
    return a.join(c, F.col("other_no") == F.col("block_no") + 1).select("block_no", "other_no", index.overlaps(F.col("al"), F.col("ah"), F.col("cl"), F.col("ch")).alias("overlaps"))


def _log(s, d, changed=False):
    """Events as JSON lines of one input; with ``changed``, some blocks as they were before."""
    level = F.create_map(*[F.lit(x) for pair in EVENT_LEVELS.items() for x in pair])[F.col("event_type")]
    kept = F.when(F.expr("event_id div 1000 % 3 = 0"), F.col("user_id") + 1).otherwise(F.col("user_id")) if changed else F.col("user_id")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), level.alias("level"), kept.alias("user_id")))
    return table(s, d, "events").select(F.lit(0).alias("input_id"), F.lit("events").alias("input_name"), F.col("event_id").alias("offset"), line.alias("raw"))


def _parse(entries):
    return records(entries, DEFAULTS)


def _reuse(s, d):
    """An index of changed blocks renewed: what is taken over has the old statistics, marked by a count that no fresh block has."""
    old = index.built(_log(s, d, True), _parse, block_bytes=1000).withColumn("entries_invalid", F.lit(-1).cast("bigint"))
    new = index.built(_log(s, d), _parse, old, 1000)
    return new.select("block_no", (F.col("entries_invalid") >= 0).alias("fresh"), "entries_valid", "ts_min", "ts_max", "flags")


UNSORTED_SQL = "SELECT b, max(CASE WHEN ts < p THEN 65536 ELSE 0 END) AS u FROM (SELECT event_id // 1000 AS b, ts, lag(ts) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS p FROM events) GROUP BY b"
_add("index_reuse_join", _reuse, f"{STATS} SELECT block_no, block_no % 3 = 0 AS fresh, entries_valid, ts_min::TIMESTAMP AS ts_min, ts_max::TIMESTAMP AS ts_max, flags | CAST(x.u AS BIGINT) AS flags FROM b JOIN ({UNSORTED_SQL}) x ON x.b = b.block_no")


def _same_hash(s, d):
    """Blocks whose content hash differs between two states of the log."""
    hashes = lambda e, n: index.in_blocks(e, 1000).groupBy("block_no").agg(index.content_hash(F.col("raw"), F.col("offset")).alias(n))
    return hashes(_log(s, d), "a").join(hashes(_log(s, d, True), "b"), "block_no").select("block_no", (F.col("a") == F.col("b")).alias("same"))


_add("index_content_hash", _same_hash, "SELECT DISTINCT event_id // 1000 AS block_no, event_id // 1000 % 3 <> 0 AS same FROM events")


def _pruned(s, d):
    entries = _log(s, d)
    keep = index.pruned(entries, index.built(entries, _parse, block_bytes=1000), datetime(2024, 1, 10), datetime(2024, 1, 12), parse_level("warning"), 1000)
    frame = LogFrame.from_records(_parse(keep)).where(Selection("warning", datetime(2024, 1, 10), datetime(2024, 1, 12)))
    return frame.sorted().select(F.col("offset").alias("event_id"), "ts")


_add("index_pruned_sort", _pruned, f"SELECT event_id, ts::TIMESTAMP AS ts FROM events WHERE {RANK_SQL} <= 1 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")


def _epochs(s, d):
    scaled = table(s, d, "events").select("event_id", F.expr("cast(unix_micros(cast(ts as timestamp)) div element_at(array(1000000, 1000, 1), cast(event_id % 3 + 1 as int)) as string)").alias("raw"))
    return scaled.withColumn("t", timestamps.parsed(F.col("raw"))).select("event_id", F.col("t.sec").alias("sec"), F.col("t.nsec").alias("nsec"))


_add(
    "epoch_units", _epochs,
    """WITH r AS (SELECT event_id, epoch_us(ts) // [1000000, 1000, 1][event_id % 3 + 1] * [1000000, 1000, 1][event_id % 3 + 1] AS us FROM events)
SELECT event_id, us // 1000000 AS sec, CAST(us % 1000000 * 1000 AS INTEGER) AS nsec FROM r""",
)
_add(
    "timestamp_rfc3339",
    lambda s, d: table(s, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+01:30")).alias("raw")).select("event_id", timestamps.parsed(F.col("raw")).alias("t")).select("event_id", "t.sec", "t.nsec", "t.offset_min"),
    "SELECT event_id, epoch_us(ts) // 1000000 - 5400 AS sec, CAST(epoch_us(ts) % 1000000 // 1000 * 1000000 AS INTEGER) AS nsec, 90 AS offset_min FROM events",
)
_add(
    "strftime_default",
    lambda s, d: table(s, d, "events").select("event_id", strftime.formatted("%Y-%m-%d %T.%3N %j %a", F.col("ts").cast("timestamp")).alias("time")),
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g %j %a') AS time FROM events",
)
_lines = lambda s, d: text.column_entries(table(s, d, "documents"), "doc_id", "text", "newline")
_by_doc = lambda df: df.groupBy(F.col("input_name").cast("long").alias("doc_id"))
LINES = """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS n FROM documents),
l AS (SELECT doc_id, regexp_replace(raw, '\r$', '') AS raw FROM p WHERE line < n OR raw <> '')"""
_add("split_lines", lambda s, d: _by_doc(_lines(s, d)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars")), f"{LINES} SELECT doc_id, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS chars FROM l GROUP BY doc_id")
_add(
    "unparsed_passthrough",
    lambda s, d: _by_doc(_parse(_lines(s, d))).agg(*(F.count_if(F.col("parse_status") == x).alias(f"n_{x}") for x in ("ok", "empty", "invalid"))),
    LINES + r""", c AS (SELECT doc_id, CASE WHEN trim(raw, E' \t\r\n') = '' THEN 'empty' WHEN regexp_full_match(raw, '[\x00-\x20]*([^\x00-\x20"''(),;<=>\[\\\]^`{|}\x7f]+=("([^"\\]|\\.)*"|[^\x00-\x20"=]*)([\x00-\x20]+|$))*') THEN 'ok' ELSE 'invalid' END AS k FROM l)
SELECT doc_id, count(*) FILTER (k = 'ok') AS n_ok, count(*) FILTER (k = 'empty') AS n_empty, count(*) FILTER (k = 'invalid') AS n_invalid FROM c GROUP BY doc_id""",
)


def _nested(s, d):
    """Events as JSON lines with a nested object, an array and empty values."""
    line = F.format_string('{"event_id":%d,"Event_Type":"%s","props":%s,"tags":[%d,"x"],"none":null,"box":{"empty":"","gone":{}}}', "event_id", "event_type", "props", "user_id")
    return _parse(table(s, d, "events").select(F.lit(0).alias("input_id"), F.lit("events").alias("input_name"), F.col("event_id").alias("offset"), line.alias("raw")))


_add(
    "flatten_keys",
    lambda s, d: _nested(s, d).select(F.col("offset").alias("event_id"), F.explode("nodes").alias("n")).where("n.kind in ('string', 'number')").select("event_id", F.col("n.path").alias("key"), F.col("n.text").alias("value")),
    """SELECT event_id, 'event-id' AS key, CAST(event_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'event-type', event_type FROM events
UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k') FROM events UNION ALL SELECT event_id, 'tags.[0]', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'tags.[1]', 'x' FROM events UNION ALL SELECT event_id, 'box.empty', '' FROM events""",
)


def _shown(s, d, hide, hide_empty):
    shown = rendered(_nested(s, d), DEFAULTS, Renderer(DEFAULTS, rules(hide), hide_empty))
    return shown.select(F.col("offset").alias("event_id"), "line")


_add(
    "hide_fields",
    lambda s, d: _shown(s, d, ["!*", "*", "!event-id", "!props.k"], False),
    "SELECT event_id, '------------ [###] event-id=' || event_id || ' props.k=' || json_extract_string(props, '$.k') || ' ...' AS line FROM events",
)
_add(
    "hide_empty",
    lambda s, d: _shown(s, d, ["tags"], True),
    "SELECT event_id, '------------ [###] event-id=' || event_id || ' Event-Type=' || event_type || ' props.k=' || json_extract_string(props, '$.k') || ' ...' AS line FROM events",
)


def _semi(negated):
    return lambda s, d: membership(table(s, d, "documents"), "doc_id", table(s, d, "labels").where("toxic = 1").select("doc_id"), negated).select("doc_id", "source")


_add("in_set_semi", _semi(False), "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add("in_set_anti", _semi(True), "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def flagship(spark, sf_dir):
    return events(spark, sf_dir).where("(level > info or value > 50) and exists(.props.k)").sorted().select("event_id", "ts", "event_type", "value")


_add("flagship", flagship, f"SELECT event_id, ts, event_type, value FROM events WHERE ({RANK_SQL} < 2 OR value > 50) AND json_extract_string(props, '$.k') IS NOT NULL")
