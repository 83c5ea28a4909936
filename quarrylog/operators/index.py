"""The block index: statistics per block, how blocks are pruned by them, and reuse of an old index.

All are aggregates and joins over records that carry ``block_no``; the tables
are small against the data (one row a block) and stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..levels import LEVELS

# A block's flags.
LEVEL_FLAGS = {"error": 0x8, "warning": 0x20, "info": 0x100, "debug": 0x1000, "trace": 0x4000}
UNSORTED, HAS_TIME = 0x10000, 0x20000


def level_flag(rank: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for i, name in enumerate(LEVELS):
        out = F.when(rank == i, F.lit(LEVEL_FLAGS[name]).cast("bigint")).otherwise(out)
    return F.coalesce(out, F.lit(0).cast("bigint"))


def level_mask(rank: int) -> int:
    """Flags of the levels that are at least as severe."""
    return sum(LEVEL_FLAGS[x] for x in LEVELS[: rank + 1])


def with_previous(records: DataFrame, block: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """``prev_ts``, ``unsorted`` (earlier than the entry before; no time sorts lowest) and ``ts_fill`` (own time, else that of the entry before, one step back)."""
    own = Window.partitionBy(*block).orderBy(*order)
    first = F.row_number().over(own) == 1
    previous = F.lag(ts).over(own)
    earlier = F.when(first, False).when(F.col(ts).isNull(), previous.isNotNull()).otherwise(F.coalesce(F.col(ts) < previous, F.lit(False)))
    return records.withColumns({"prev_ts": previous, "unsorted": earlier, "ts_fill": F.coalesce(F.col(ts), previous)})


def chronology(records: DataFrame, block: list[str], order: list[str], ts: str = "ts_fill") -> DataFrame:
    """``chrono``: the entry's place in its block's order of time; ties in file order."""
    return records.withColumn("chrono", F.row_number().over(Window.partitionBy(*block).orderBy(F.col(ts).asc_nulls_first(), *order)))


def block_stats(records: DataFrame, block: list[str], ts: str = "ts", rank: Column | None = None, valid: Column | None = None, unsorted: Column | None = None) -> DataFrame:
    """One row a block: counts, first and last time, flags.  Partial aggregates only: no block is brought together."""
    valid = F.lit(True) if valid is None else valid
    flag = level_flag(rank) if rank is not None else F.lit(0).cast("bigint")
    flag = flag.bitwiseOR(F.when(F.col(ts).isNotNull(), HAS_TIME).otherwise(0).cast("bigint"))
    if unsorted is not None:
        flag = flag.bitwiseOR(F.when(unsorted, UNSORTED).otherwise(0).cast("bigint"))
    return records.groupBy(*block).agg(
        F.sum(valid.cast("bigint")).alias("entries_valid"), F.sum((~valid).cast("bigint")).alias("entries_invalid"),
        F.min(F.when(valid, F.col(ts))).alias("ts_min"), F.max(F.when(valid, F.col(ts))).alias("ts_max"), F.bit_or(F.when(valid, flag).otherwise(0)).alias("flags"),
    )


def merged_stats(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.groupBy(*keys).agg(
        F.sum("entries_valid").alias("entries_valid"), F.sum("entries_invalid").alias("entries_invalid"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.bit_or("flags").alias("flags"),
    )


def possible(since=None, until=None, rank: int | None = None) -> Column:
    """Which rows of ``block_stats`` a selection may find records in, when sorting by time."""
    out = (F.col("entries_valid") > 0) & (F.col("flags").bitwiseAND(F.lit(HAS_TIME)) != 0)
    if since is not None:
        out = out & (F.col("ts_max") >= F.lit(since))
    if until is not None:
        out = out & (F.col("ts_min") <= F.lit(until))
    if rank is not None:
        out = out & (F.col("flags").bitwiseAND(F.lit(level_mask(rank))) != 0)
    return out


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Whether either end of the other interval lies in this one; one that lies inside the other isn't seen."""
    return other_lo.between(lo, hi) | other_hi.between(lo, hi)


def reusable(blocks: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` with the statistics of ``old`` blocks of the same number and hash; ``fresh`` marks those to compute."""
    stats = ["entries_valid", "entries_invalid", "ts_min", "ts_max", "flags"]
    return blocks.join(old.select(*keys, *stats), keys, "left").withColumn("fresh", F.col("entries_valid").isNull())


def content_hash(raw: Column, order: Column) -> Column:
    """Of a block's entries whatever order they arrive in: each is hashed with its place."""
    return F.sum(F.xxhash64(raw, order).cast("decimal(38,0)")).cast("string")


#: Bytes of an input that make a block.
BLOCK_BYTES = 1 << 20
KEYS = ["input_name", "block_no"]
STATS = ["entries_valid", "entries_invalid", "ts_min", "ts_max", "flags"]


def in_blocks(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return entries.withColumn("block_no", F.expr(f"offset div {block_bytes}"))


def built(entries: DataFrame, parse, old: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of ENTRY rows: KEYS, ``hash`` and STATS of each block.

    ``parse`` makes records of entries.  Blocks that ``old``, an index too, has
    with the same hash are taken from it and not parsed.
    """
    blocked = in_blocks(entries, block_bytes)
    blocks = blocked.groupBy(*KEYS).agg(content_hash(F.col("raw"), F.col("offset")).alias("hash"))
    known = None
    if old is not None:
        known = reusable(blocks, old, [*KEYS, "hash"])
        blocked = blocked.join(known.where("fresh").select(*KEYS), KEYS, "left_semi")
    made = in_blocks(parse(blocked.drop("block_no")), block_bytes).withColumn("valid", F.col("parse_status") == "ok")
    made = with_previous(made, [*KEYS, "valid"], ["offset", "rec_no"])
    out = block_stats(made, KEYS, rank=F.col("level_rank"), valid=F.col("valid"), unsorted=F.col("unsorted")).join(blocks, KEYS).select(*KEYS, "hash", *STATS)
    if known is not None:
        out = out.unionByName(known.where("not fresh").select(*KEYS, "hash", *STATS))
    return out


def pruned(entries: DataFrame, blocks: DataFrame, since=None, until=None, rank: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Entries of the blocks that a selection may find timed records in."""
    keep = blocks.where(possible(since, until, rank)).select(*KEYS)
    return in_blocks(entries, block_bytes).join(keep, KEYS, "left_semi").select(*entries.columns)
