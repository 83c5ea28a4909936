"""A corpus pipeline over ``documents``; each stage works on all that the one before kept.

quality_rules rejects documents, line_dedup takes repeated lines out of texts and
leaves out documents that lose all their words so, jaccard_join keeps the document
with the smallest doc_id of each group of near copies among those left, pii masks
personal data, and packing lays the tokens of what is left out in sequences.
Near copies are compared twice: by their texts in ``documents``, as what line_dedup
leaves of a copy no longer looks like one, and then by what line_dedup left, as texts
may be near copies but for the lines that it took.  All but the last return the columns of
``documents``, with ``n_chars`` counted anew where a text changes.

Defined results: a null, empty or blank text is rejected by the first stage; rows
with a null doc_id lose no lines and are no near copies; repeated rows stay or go
together; of documents that tie as a group's first the smallest doc_id stays; an
empty table gives no pieces; further columns are carried through, whatever their
names; very long texts go through whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import jaccard_join, line_dedup, packing, pii, quality
from quarrylog.llm.common import documents, quoted, saved


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars as the texts now have them."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*map(quoted, like.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(docs, counts=False)
    return _counted(kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = saved(jaccard_join.representatives(docs, documents(spark, sf_dir).select("doc_id", "text")), "whole-text-copies")
    # rows of the same doc_id stay or go together here too
    return jaccard_join.representatives(whole, whole.select("doc_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitised(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_copy_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Shingle components, co-occurrence and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
