"""Log texts: files in argument order, compressed or not, split into entries by any of the delimiters."""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.records import ENTRY

#: Delimiters that a reader can split by itself.
SEPARATORS = {"lf": "\n", "cr": "\r", "nul": "\0", "crlf": "\r\n", "newline": "\n"}
# First bytes of compressed files.
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


def delimiter_for(input_format: str = "auto", allow_prefix: bool = False, explicit: str | None = None) -> str:
    """An explicit one, else by format: whole JSON objects for json, newlines for logfmt and prefixed lines."""
    if explicit and explicit != "auto":
        return explicit
    if allow_prefix or input_format == "logfmt":
        return "newline"
    return "json" if input_format == "json" else "pretty"


def compression(head: bytes) -> str | None:
    return next((name for magic, name in MAGIC.items() if head.startswith(magic)), None)


def inflated(data: bytes) -> bytes:
    """Decompressed by what the content says, as often as frames follow each other."""
    kind = compression(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    return {"gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress, None: bytes}[kind](data)


def resolve(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of the paths and globs in argument order; a missing file or a directory fails before anything is read."""
    hadoop, out = spark._jvm.org.apache.hadoop.fs, []
    for path in paths:
        where = hadoop.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        for status in sorted(found, key=lambda s: str(s.getPath())):
            if status.isDirectory():
                raise IsADirectoryError(path)
            out.append(status.getPath().toString())
    return out


def split_pretty(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Entries and their offsets: a newline ends one unless a brace, space or tab follows."""
    start = 0
    for m in re.finditer(rb"\r?\n(?![} \t])", data):
        yield start, data[start : m.start()]
        start = m.end()
    if start < len(data):
        yield start, data[start:]


def split_json(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Entries and their offsets: white space with a newline ends one between ``}`` (or text that needs no more) and ``{`` (or text that adds none), and at the end."""
    start = 0
    for m in re.finditer(rb"[ \t\r\n]*\n[ \t\r\n]*", data):
        left, right = data[m.start() - 1 : m.start()], data[m.end() : m.end() + 1]
        if not right or left == b"}" and right not in b",[]}:" or right == b"{" and left and left not in b",[:{":
            yield start, data[start : m.start()]
            start = m.end()
    if start < len(data):
        yield start, data[start:]


def split_plain(data: bytes, separator: bytes) -> Iterator[tuple[int, bytes]]:
    start = 0
    parts = data.split(separator)
    for part in parts[:-1]:
        yield start, part
        start += len(part) + len(separator)
    if parts[-1]:
        yield start, parts[-1]


def splitter(delimiter: str):
    """A function from bytes to entries and their offsets."""
    if delimiter == "pretty":
        return split_pretty
    if delimiter == "json":
        return split_json
    return lambda data: ((at, x[:-1] if delimiter == "newline" and x.endswith(b"\r") else x) for at, x in split_plain(data, SEPARATORS[delimiter].encode()))


def bare(path: str) -> str:
    """A path as it is told by all of Spark's ways to tell it."""
    return re.sub(r"^file:/+", "/", path)


def entry_rows(schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def whole_files(spark: SparkSession, files: dict[str, int], delimiter: str) -> DataFrame:
    """Entries of compressed files, which no reader can split. One task a file."""
    schema, split = _parse_datatype_string(ENTRY), splitter(delimiter)
    ids = {bare(f): i for f, i in files.items()}

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for at, raw in split(inflated(content)):
                    rows.append((ids[bare(path)], path, at, raw.decode("utf-8", "replace")))
                    if len(rows) == 10_000:
                        yield entry_rows(arrow, rows)
                        rows = []
                if rows:
                    yield entry_rows(arrow, rows)

    return spark.read.format("binaryFile").load(list(files)).select("path", "content").mapInArrow(run, schema)


def numbered(spark: SparkSession, rows: DataFrame, files: dict[str, int]) -> DataFrame:
    """``rows`` with the input_id of their ``path``: as many pairs as there are inputs."""
    pairs = [F.lit(x) for f, i in files.items() for x in (bare(f), i)]
    return rows.withColumn("input_id", F.element_at(F.create_map(*pairs), F.regexp_replace("path", "^file:/+", "/")))


def plain_lines(spark: SparkSession, files: dict[str, int], delimiter: str) -> DataFrame:
    """Entries of files that a reader splits by itself; ``offset`` grows with the position in the file.

    A split of a file that has several fills its task, so a line's number in its
    task is less than the bytes before it in the split.
    """
    df = spark.read.option("lineSep", SEPARATORS[delimiter]).text(list(files))
    raw = F.regexp_replace("value", r"\r\z", "") if delimiter == "newline" else F.col("value")
    place = F.col("_metadata.file_block_start") + 1 + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(F.col("_metadata.file_path").alias("path"), place.alias("offset"), raw.alias("raw"))
    return numbered(spark, rows, files).select("input_id", F.col("path").alias("input_name"), "offset", "raw")


def column_entries(df: DataFrame, ident: str, column: str, delimiter: str) -> DataFrame:
    """ENTRY rows of a text column: each value is an input, told by ``ident``; a null has no entries."""
    schema, split = _parse_datatype_string(ENTRY), splitter(delimiter)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(0, name, at, raw.decode("utf-8", "replace")) for at, raw in split(data)]
                if len(rows) > 10_000:
                    yield entry_rows(arrow, rows)
                    rows = []
            if rows:
                yield entry_rows(arrow, rows)

    return df.where(F.col(column).isNotNull()).select(F.col(ident).cast("string"), F.col(column).cast("binary")).mapInArrow(run, schema)


#: What an entry is to its split: whole, or the part at its beginning, at its end, or all that it has.
WHOLE, HEAD, TAIL, ALL = range(4)
PARTS = "path string, start bigint, role int, offset bigint, raw binary"


def split_files(spark: SparkSession, files: dict[str, int], delimiter: str) -> DataFrame:
    """Entries of delimiters that look past a line, from splittable files.

    Each split is regrouped by itself.  Its first and last entries may go on in
    the splits beside it: these, two a split, are joined in file order and split
    again.  ``offset`` grows with the position in the file; in the first split
    it is the position.
    """
    split, schema, entry = splitter(delimiter), _parse_datatype_string(PARTS), _parse_datatype_string(ENTRY)
    where = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text(list(files))
    lines = read.select(where.file_path.alias("path"), where.file_block_start.alias("start"), (where.file_block_length >= where.file_size).alias("single"), F.col("value").cast("binary").alias("value"))

    def regrouped(wanted):
        def run(batches):
            arrow = to_arrow_schema(schema)
            key, pending, base, first, out = None, b"", 0, True, []

            def row(role, at, raw):
                path, start, _ = key
                return path, start, role, start + (start > 0) + at, raw

            def closed():
                """The split's last entry."""
                for at, raw in split(pending) if key[2] else [(0, pending[:-1])]:
                    out.append(row(WHOLE if key[2] else ALL if first else TAIL, base + at, raw))

            for batch in batches:
                paths = batch.column(0).dictionary_encode()
                codes, starts = paths.indices.to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if a == z:
                        continue
                    now = (paths.dictionary[int(codes[a])].as_py(), int(starts[a]), batch.column(2)[a].as_py())
                    if now != key:
                        if key:
                            closed()
                        key, pending, base, first = now, b"", 0, True
                    pending += b"\n".join(batch.column(3).slice(a, z - a).to_pylist()) + b"\n"
                    found = list(split(pending))
                    for at, raw in found[:-1]:
                        out.append(row(HEAD if first and not key[2] else WHOLE, base + at, raw))
                        first = False
                    if found:
                        pending, base = pending[found[-1][0] :], base + found[-1][0]
                out = [x for x in out if (x[2] == WHOLE) == wanted]
                if out:
                    yield entry_rows(arrow, out)
                    out = []
            if key:
                closed()
            out = [x for x in out if (x[2] == WHOLE) == wanted]
            if out:
                yield entry_rows(arrow, out)

        return run

    def decoded(batches):
        arrow = to_arrow_schema(entry)
        for batch in batches:
            rows = []
            for number, path, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begins = np.cumsum([0] + [len(p["raw"]) + 1 for p in parts])
                for at, raw in split(b"".join(p["raw"] + b"\n" for p in parts)):
                    k = int(np.searchsorted(begins, at, side="right")) - 1
                    rows.append((number, path, parts[k]["offset"] + at - int(begins[k]), raw.decode("utf-8", "replace")))
            if rows:
                yield entry_rows(arrow, rows)

    whole = numbered(spark, lines.mapInArrow(regrouped(True), schema), files)
    whole = whole.select("input_id", F.col("path").alias("input_name"), "offset", F.col("raw").cast("string").alias("raw"))
    ends = numbered(spark, lines.where("not single").mapInArrow(regrouped(False), schema), files)
    run = F.sum(F.when(F.col("role") == TAIL, 1).otherwise(0)).over(Window.partitionBy("input_id").orderBy("start", "role"))
    joined = ends.withColumn("run", run).groupBy("input_id", "path", "run").agg(F.array_sort(F.collect_list(F.struct("offset", "raw"))).alias("parts"))
    return whole.unionByName(joined.select("input_id", "path", "parts").mapInArrow(decoded, entry))


def heads(spark: SparkSession, files: list[str]) -> dict[str, bytes]:
    """The first six bytes of each file."""
    out, conf = {}, spark._jsc.hadoopConfiguration()
    for path in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(conf).open(where)
        out[path] = bytes(stream.readNBytes(6))
        stream.close()
    return out


#: Names by which a reader would inflate a file, whatever it holds.
CODECS = (".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4", ".xz")


def entries(spark: SparkSession, paths: list[str], delimiter: str = "pretty") -> DataFrame:
    """ENTRY rows of all files; their order is (input_id, offset)."""
    files = {f: i for i, f in enumerate(resolve(spark, paths))}
    packed = {f: files[f] for f, head in heads(spark, list(files)).items() if compression(head) or f.endswith(CODECS)}
    rest = {f: i for f, i in files.items() if f not in packed}
    parts = [whole_files(spark, packed, delimiter)] if packed else []
    if rest:
        parts.append(plain_lines(spark, rest, delimiter) if delimiter in SEPARATORS else split_files(spark, rest, delimiter))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def stdin_entries(spark: SparkSession, stream, delimiter: str = "pretty") -> DataFrame:
    """Standard input, copied piece by piece to a file in the shared folder, so that executors can read it, and again."""
    path = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}.log"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    while piece := stream.read(1 << 20):
        out.write(bytearray(piece))
    out.close()
    return entries(spark, [path], delimiter).withColumn("input_name", F.lit("-"))
