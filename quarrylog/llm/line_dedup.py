"""Line deduplication across documents.

Lines are exploded as 128-bit hashes of their normalised keys, with their
positions; distinct documents are counted per hash, and a key that at least
MIN_DOCS documents hold stays only in the smallest doc_id holding it.  The
positions that a text loses go back to it, and its other lines are joined again
in their order.

Defined results: a null or empty text is one empty line; a null doc_id never
counts as a holder and loses nothing; rows that share a doc_id, repeated ones
too, are one document for counting and each loses the same keys; keys under
MIN_CHARS code points always stay; an empty table gives an empty result; a very long text is split and
joined whole; columns of ``docs`` keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .arrow import map_texts
from .common import ddl_of, documents, lookup, quoted, saved, unused

MIN_CHARS, MIN_DOCS = 10, 2


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of a line's key; None if the key is too short.  bytes.strip and bytes.lower know ASCII only, as the key does."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, row, places): each different long key of each text and the positions of its lines; ``row`` tells texts that share a doc_id apart."""

    def make():
        def explode(part):
            out = [[], [], [], []]
            for i, row, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast("binary").to_pylist(), strict=True):
                if i is None or not b:
                    continue
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(b.split(b"\n")):
                    if (key := line_hash(line, min_chars)) is not None:
                        own.setdefault(key, []).append(at)
                out[0].extend(own)
                out[1].extend([i] * len(own))
                out[2].extend([row] * len(own))
                out[3].extend(own.values())
            return out

        return explode

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return map_texts(rows, "key binary, doc_id long, row long, places array<int>", make, 2)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row and the positions ``lost`` of its lines; only texts that lose some."""
    keys = saved(line_keys(docs, min_chars), "line-keys")
    first = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("holders")).where(F.col("holders") >= min_docs).select("key", "first")
    gone = lookup(keys, saved(first, "line-first"), "key").where("doc_id > first")
    return gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("places")).alias("lost"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """All columns of ``docs``, the text rejoined from the lines that stay, then ``n_lines`` and ``n_dropped`` unless ``counts`` is false.

    If ``docs`` has columns of these two names, the counts are n_lines_1 and so on.
    """
    names, at = docs.columns, docs.columns.index("text")
    # names that no column has
    own = [unused(x, names) for x in ("doc_id", "row", "lost", "n_lines", "n_dropped")]
    lost = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs).toDF(*own[:3])
    joined = docs.join(lost, (F.col("`doc_id`") == F.col(own[0])) & (F.xxhash64("text") == F.col(own[1])), "left").select(*map(quoted, names), own[2])

    def make():
        def rejoin(part):
            texts, n_lines, n_dropped = [], [], []
            for b, gone in zip(part.column(at).cast("binary").to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                lines = (b or b"").split(b"\n")
                kept = lines
                if gone:
                    gone = set(gone)
                    kept = [x for k, x in enumerate(lines) if k not in gone]
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            return [texts if i == at else part.column(i) for i in range(len(names))] + ([n_lines, n_dropped] if counts else [])

        return rejoin

    return map_texts(joined, ddl_of(docs.schema) + (f", {own[3]} long, {own[4]} long" if counts else ""), make, at)


def op2_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped and kept_sha256 of every whole text of ``documents``."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
