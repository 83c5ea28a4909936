"""Command line: ``python -m quarrylog [options] FILE...``."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import time
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

from . import settings as configuration
from .frame import LogFrame, ordered
from .functions.timearg import parse_time
from .levels import parse_level
from .operators import index
from .operators.records import records
from .operators.visibility import rules
from .plans.filters import Selection
from .render import Renderer, rendered
from .sources import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylog", add_help=False)
    p.add_argument("--help", action="help")
    a = p.add_argument
    a("files", nargs="*")
    a("--config", action="append", default=[])
    a("-s", "--sort", action="store_true")
    a("-F", "--follow", action="store_true")
    a("--tail", type=int)
    a("--sync-interval-ms", type=int, default=100)
    a("-f", "--filter", action="append", default=[])
    a("-q", "--query", action="append", default=[])
    a("-l", "--level")
    a("--since")
    a("--until")
    a("-h", "--hide", action="append", default=[])
    a("-e", "--hide-empty-fields", action="store_true")
    a("-r", "--raw", action="store_true")
    a("--raw-fields", action="store_true")
    a("-t", "--time-format")
    a("-Z", "--time-zone")
    a("--input-format", choices=["auto", "json", "logfmt"], default="auto")
    a("--input-info", choices=["none", "minimal", "compact", "full"], default="none")
    a("--allow-prefix", action="store_true")
    a("--delimiter", choices=["auto", "cr", "lf", "crlf", "newline", "nul"], default="auto")
    a("--max-message-size", type=int, default=64 << 20)
    a("--flatten", choices=["always", "never"])
    a("-x", "--expansion", choices=["never", "inline", "auto", "always"])
    a("-o", "--output")
    a("--output-delimiter", choices=["newline", "nul"], default="newline")
    a("--dump-index", action="store_true")
    a("--index", help="folder that keeps the index of blocks between runs")
    return p


def selection(o: argparse.Namespace, conf: dict) -> Selection:
    now = datetime.now(ZoneInfo(conf["time-zone"]))
    at = lambda x: parse_time(x, now, conf["time-format"]) if x else None
    return Selection(o.level, at(o.since), at(o.until), o.filter, o.query)


def parsed(entries: DataFrame, o: argparse.Namespace, conf: dict, limit: int | None = None) -> DataFrame:
    return records(entries, conf, input_format=o.input_format, allow_prefix=o.allow_prefix, limit=limit, max_size=o.max_message_size)


def indexed(spark: SparkSession, entries: DataFrame, o: argparse.Namespace, conf: dict) -> DataFrame:
    """The index of the inputs.  With ``--index``, blocks unchanged since the last run are not parsed again, and the new index is kept for the next."""
    if not o.index:
        return index.built(entries, lambda e: parsed(e, o, conf))
    # what is parsed depends on the settings, so each has an index of its own
    key = hashlib.sha256(json.dumps([conf["fields"], o.input_format, o.allow_prefix, o.max_message_size], sort_keys=True, default=str).encode()).hexdigest()[:16]
    system = spark._jvm.org.apache.hadoop.fs
    folder = system.Path(f"{o.index}/{key}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(x.getPath().toString() for x in fs.listStatus(folder) if fs.exists(system.Path(x.getPath(), "_SUCCESS"))) if fs.exists(folder) else []
    old = spark.read.parquet(versions[-1]) if versions else None
    path = f"{folder.toString()}/{time.time_ns():020d}"
    index.built(entries, lambda e: parsed(e, o, conf), old).write.parquet(path)
    for version in versions[:-1]:  # the last may still be read by another run
        fs.delete(system.Path(version), True)
    return spark.read.parquet(path)


def lines(spark: SparkSession, o: argparse.Namespace, conf: dict) -> DataFrame:
    """The plan of a batch run: its ``line`` column is the output, in order."""
    delimiter = text.delimiter_for(o.input_format, o.allow_prefix, o.delimiter)
    entries = text.entries(spark, o.files, delimiter) if o.files and o.files != ["-"] else text.stdin_entries(spark, sys.stdin.buffer, delimiter)
    chosen = selection(o, conf)
    if o.sort and o.index and o.tail is None:
        entries = index.pruned(entries, indexed(spark, entries, o, conf), chosen.since, chosen.until, parse_level(chosen.level) if chosen.level else None)
    frame = LogFrame.from_records(parsed(entries, o, conf, 1 if o.sort else None))
    if o.tail is not None:
        frame = frame.tail(o.tail)
    passthrough = chosen.empty and o.input_format == "auto" and not o.sort
    if not chosen.empty:
        frame = frame.where(chosen)
    rows = (frame.timed() if o.sort else frame).df
    renderer = Renderer(conf, rules(o.hide, conf["fields"]["hide"]), o.hide_empty_fields, o.raw_fields)
    shown = rendered(rows, conf, renderer, o.raw, passthrough, None if o.input_info == "none" else o.input_info)
    order = ["ts_sec", "ts_nsec", "input_id", "offset", "rec_no"] if o.sort else ["input_id", "offset", "rec_no"]
    return ordered(shown, ("input_id", "offset", "rec_no"), *order).select("line")


def write_file(spark: SparkSession, shown: DataFrame, path: str, end: str) -> None:
    """The lines, written by the executors in parts that are then joined in order."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf, parts, where = spark._jsc.hadoopConfiguration(), fs.Path(f"{path}.parts"), fs.Path(path)
    shown.write.option("lineSep", end).mode("overwrite").text(parts.toString())
    system = where.getFileSystem(conf)
    out = system.create(where, True)
    for part in sorted(x.getPath().toString() for x in system.listStatus(parts)):
        if "/part-" in part:
            stream = system.open(fs.Path(part))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    out.close()
    system.delete(parts, True)


def configured(o: argparse.Namespace) -> dict:
    conf = configuration.load(*configuration.layers(dict(os.environ), Path.home()), *o.config)
    over = {"time-format": o.time_format, "time-zone": o.time_zone}
    conf |= {k: v for k, v in over.items() if v}
    if o.flatten:
        conf["formatting"]["flatten"] = o.flatten
    if o.expansion:
        conf["formatting"]["expansion"]["mode"] = o.expansion
    return conf


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    o = parser().parse_args(args)
    conf = configured(o)
    spark = spark or SparkSession.builder.appName("quarrylog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    end = "\0" if o.output_delimiter == "nul" else "\n"
    if o.follow:
        from .streaming import follow

        renderer = Renderer(conf, rules(o.hide, conf["fields"]["hide"]), o.hide_empty_fields, o.raw_fields)
        made = records(follow.follow(spark, o.files, 10 if o.tail is None else o.tail), conf, input_format=o.input_format, allow_prefix=o.allow_prefix)
        frame = LogFrame.from_records(made)
        chosen = selection(o, conf)
        made = (frame if chosen.empty else frame.where(chosen)).df

        def emit(rows):
            for row in rows:
                shown = row["raw"] if o.raw or row["parse_status"] != "ok" else renderer.line(row, str(row["ts"]))
                print(("  " if row["in_sync"] else "! ") + shown, end=end, file=out or sys.stdout, flush=True)

        follow.run(made, emit, f"{o.sync_interval_ms} milliseconds").awaitTermination()
        return 0
    if o.dump_index:
        entries = text.entries(spark, o.files, text.delimiter_for(o.input_format, o.allow_prefix, o.delimiter))
        for row in indexed(spark, entries, o, conf).orderBy(*index.KEYS).toJSON().toLocalIterator():
            (out or sys.stdout).write(row + end)
        return 0
    shown = lines(spark, o, conf)
    if o.output:
        write_file(spark, shown, o.output, end)
    else:
        try:
            for row in shown.toLocalIterator():
                (out or sys.stdout).write(row.line + end)
        except BrokenPipeError:
            return 0
    return 0
