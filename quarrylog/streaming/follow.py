"""Follow mode: growing files as a stream, merged live in the order of time.

The source keeps, per file, its inode and how far it was read, so appended,
truncated and replaced files go on where they should.  Nothing is ever dropped
for being late: records that come out of order are marked instead, so there is
no watermark.  A batch is what arrived within the trigger's interval.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.records import ENTRY

#: Bytes of each file that one batch takes at most; the rest waits for the next.
MAX_BATCH_BYTES = 16 << 20


class AppendedLinesReader(SimpleDataSourceStreamReader):
    """Entries appended to files since the last offset, {path: [inode, byte]}."""

    def __init__(self, options: dict):
        self.patterns = options["path"].split(",")
        self.tail = int(options.get("tail", 10))

    def paths(self) -> list[str]:
        return [p for pattern in self.patterns for p in (sorted(glob.glob(pattern)) or [pattern])]

    def initialOffset(self) -> dict:
        """Where the last ``tail`` lines of each file begin."""
        return {p: [os.stat(p).st_ino, tail_start(p, self.tail)] if os.path.exists(p) else [0, 0] for p in self.paths()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for n, path in enumerate(self.paths()):
            if not os.path.exists(path):
                end[path] = [0, 0]
                continue
            inode, at = start.get(path, [0, 0])
            now = os.stat(path)
            if now.st_ino != inode or now.st_size < at:
                at = 0
            found, at = lines_from(path, at, MAX_BATCH_BYTES)
            rows += [(n, path, offset, text) for offset, text in found]
            end[path] = [now.st_ino, at]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a failure."""
        rows = []
        for n, path in enumerate(self.paths()):
            if path not in end or not os.path.exists(path):
                continue
            inode, stop = end[path]
            was, at = start.get(path, [0, 0])
            if was != inode or stop < at:
                at = 0
            found, _ = lines_from(path, at, max(0, stop - at))
            rows += [(n, path, offset, text) for offset, text in found]
        return iter(rows)


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended-lines"

    def schema(self) -> str:
        return ENTRY

    def simpleStreamReader(self, schema: StructType) -> AppendedLinesReader:
        return AppendedLinesReader(self.options)


def lines_from(path: str, at: int, limit: int) -> tuple[list[tuple[int, str]], int]:
    """Whole lines (offset, text) from byte ``at`` on, within ``limit`` bytes but at least one, and where they end."""
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(limit)
        if data and b"\n" not in data:
            data += f.readline()
    data = data[: data.rfind(b"\n") + 1]
    out, offset = [], at
    for line in data.split(b"\n")[:-1]:
        out.append((offset, line.removesuffix(b"\r").decode("utf-8", "replace")))
        offset += len(line) + 1
    return out, at + len(data)


def tail_start(path: str, lines: int, step: int = 65_536) -> int:
    """Where the last ``lines`` lines begin, read from the end; a newline at the very end ends no further line."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at, wanted = size, lines
        if size:
            f.seek(size - 1)
            wanted += f.read(1) == b"\n"
        while at > 0:
            begin = max(0, at - step)
            f.seek(begin)
            block = f.read(at - begin)
            k = len(block)
            while (k := block.rfind(b"\n", 0, k)) >= 0:
                wanted -= 1
                if wanted == 0:
                    return begin + k + 1
            at = begin
    return 0


def follow(spark: SparkSession, paths: list[str], tail: int = 10) -> DataFrame:
    """A stream of ENTRY rows."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended-lines").option("path", ",".join(paths)).option("tail", tail).load()


def with_gap_times(records: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """``sort_sec`` and ``sort_nsec``: a record's own time; for text without one that of the next record of its input, else the latest that ``latest`` (input_id, last_sec, last_nsec) has from before."""
    after = Window.partitionBy("input_id").orderBy("offset", "rec_no").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("ts_sec").isNotNull(), F.struct("ts_sec", "ts_nsec"))
    out = records.withColumn("__next", F.first(own, ignorenulls=True).over(after))
    if latest is not None:
        out = out.join(F.broadcast(latest), "input_id", "left")
    else:
        out = out.withColumns({"last_sec": F.lit(None).cast("bigint"), "last_nsec": F.lit(None).cast("int")})
    return out.withColumns({"sort_sec": F.coalesce("__next.ts_sec", "last_sec"), "sort_nsec": F.coalesce("__next.ts_nsec", "last_nsec")}).drop("__next", "last_sec", "last_nsec")


class Merger:
    """Batches in, rows in live order out, each with ``in_sync``: false where it is earlier than the row before it.

    What it remembers is one time, and one per input; both grow with the number
    of inputs, not with what they hold.
    """

    def __init__(self, emit: Callable[[list], None]):
        self.emit, self.last, self.latest = emit, None, {}

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> None:
        spark = batch.sparkSession
        known = [(k, *v) for k, v in self.latest.items()]
        before = spark.createDataFrame(known, "input_id int, last_sec bigint, last_nsec int") if known else None
        # text before all records has no time and comes first, in file order
        ordered = with_gap_times(batch, before).orderBy(F.col("sort_sec").asc_nulls_first(), F.col("sort_nsec").asc_nulls_first(), "input_id", "offset", "rec_no")
        out = []
        for row in ordered.toLocalIterator():  # a batch is bounded by MAX_BATCH_BYTES a file
            at = None if row.sort_sec is None else (row.sort_sec, row.sort_nsec)
            out.append(row.asDict() | {"in_sync": at is None or self.last is None or at >= self.last})
            if at is not None:
                self.last = at
            if row.ts_sec is not None:
                own = (row.ts_sec, row.ts_nsec)
                self.latest[row.input_id] = max(self.latest.get(row.input_id, own), own)
        self.emit(out)


def run(records: DataFrame, emit: Callable[[list], None], interval: str = "100 milliseconds", checkpoint: str | None = None, once: bool = False):
    """Start the live merge of a stream of records; filters belong before it."""
    writer = records.writeStream.foreachBatch(Merger(emit))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
