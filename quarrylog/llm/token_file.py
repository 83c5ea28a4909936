"""A compact file of token ids.

Ids are ranked by how often the corpus has them, so frequent ids are small.
Ranks are written byte-aligned: one to four bytes each, least significant
first, in a data stream; two bits a rank, four ranks a byte, give the sizes in
a control stream apart from it.  Decoding takes a control byte's four sizes
from a table and gathers the data bytes with numpy.

A file is a Parquet directory of pages (documents in ascending doc_id order)
beside a Parquet table of the ids by rank.

Defined results: a null or empty text has the end id alone; null doc_ids come
first; rows that share a doc_id, repeated ones too, follow one another in the
order of a hash of their texts; an empty table gives a file without pages; extra columns
are ignored, whatever their names; a very long text is encoded whole, in a page
of its own if it fills one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import schema_of, slices
from .chunks import ROWS
from .common import documents, forget, saved, shared_dir
from .library_tokens import batch_ids, word_level

#: Documents and ids that close a page.
PAGE_DOCS, PAGE_IDS = 1024, 1 << 18
#: Control byte -> the sizes of its four values.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    values = values.astype("<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    # only as many bytes of each value are looked at as the widest one has
    width = int(codes.max(initial=0)) + 1
    used = np.arange(width, dtype=np.uint8) <= codes[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    values = np.zeros(n, np.uint32)
    for k in range(int(sizes.max(initial=0))):
        values |= np.where(sizes > k, raw[at + k].astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    return values


PLAIN = "part int, before long, doc_ids array<long>, sizes array<long>, width int, ids binary"
PAGES = "part int, before long, doc_ids array<long>, sizes array<long>, control binary, data binary"


def encoded(docs: DataFrame, encoder: Callable[[str], object], path: str, end: int) -> DataFrame:
    """PLAIN pages of ids, in ascending doc_id order: by part, then by the ids before in the part.

    Texts are sorted before they are encoded, so ids are never shuffled.
    """
    # the bounds of ranges are sampled in the driver: numbers only
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h")
    schema = schema_of(PLAIN)

    def run(batches):
        arrow = to_arrow_schema(schema)
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0

        def page():
            nonlocal before, held
            every = np.concatenate(ids)
            width = 2 if int(every.max()) < 1 << 16 else 4
            out = pa.RecordBatch.from_pylist([{"part": part, "before": before, "doc_ids": docs, "sizes": list(map(len, ids)), "width": width, "ids": every.astype(f"<u{width}").tobytes()}], arrow)
            before, held = before + held, 0
            docs.clear()
            ids.clear()
            return out

        for batch in slices(batches, 1, **ROWS):
            for d, x in zip(batch.column(0).to_pylist(), batch_ids(encode, batch.column(1), end), strict=True):
                docs.append(d)
                ids.append(x)
                held += len(x)
                if len(docs) >= PAGE_DOCS or held >= PAGE_IDS:
                    yield page()
        if docs:
            yield page()

    return ordered.mapInArrow(run, schema)


def plain_ids(width: int, raw) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def frequencies(pages: DataFrame) -> DataFrame:
    """id and its count over all documents; a task sends each id once."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(plain_ids(width, b.as_buffer()))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return pages.select("width", "ids").mapInArrow(run, schema_of("id long, n long")).groupBy("id").agg(F.sum("n").alias("n"))


def write(pages: DataFrame, path: str) -> None:
    """Write PLAIN pages as a file at ``path``; they are read twice, so they should be a table."""
    spark = pages.sparkSession
    counts = frequencies(pages).collect()  # as many rows as the vocabulary has ids, at most
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    given, schema = spark.sparkContext.broadcast(rank), schema_of(PAGES)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            packed = [pack(given.value[plain_ids(w, b.as_buffer())]) for w, b in zip(batch.column(4).to_pylist(), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], schema=arrow)

    pages.mapInArrow(run, schema).write.parquet(f"{path}/pages")


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of the file at ``path``."""
    order = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    table = spark.sparkContext.broadcast(order)
    pages = spark.read.schema(PAGES).parquet(f"{path}/pages")
    # one row for each writing task
    sizes = sorted((r.part, r.n) for r in pages.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0] + [n for _, n in sizes]).tolist(), strict=False))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, docs, counts, control, data = (c[k] for c in batch.columns)
                counts = counts.values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = table.value[unpack(control.as_buffer(), data.as_buffer(), int(ends[-1]))]
                own = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(ends[:-1] + starts[part.as_py()] + before.as_py(), pa.int64()), own], names=["doc_id", "start", "ids"])

    return pages.mapInArrow(run, schema_of("doc_id long, start long, ids binary"))


def op3_token_file(spark, sf_dir):
    """doc_id, start, n_tokens and ids_crc32 of every whole text of ``documents``, read back from its file."""
    import public_tokenizers

    pages = saved(encoded(documents(spark, sf_dir), word_level, public_tokenizers.path("word_bpe_49k.json"), 2), "token-ids")
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write(pages, path)
    forget(pages)
    return read(spark, path).selectExpr("doc_id", "start", "cast(length(ids) div 4 as long) AS n_tokens", "crc32(ids) AS ids_crc32")
