"""Shared plumbing of the training-data operators.

Everything here is about running on a cluster: tables that cut lineage live in
the shared folder named by ``spark.checkpoint.dir`` and joins on keys that may
hold a large part of all rows go through :func:`lookup`.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE, so at most
#: HOT_SHARE keys are hot, however large the table is.
HOT_SHARE = 1000
#: Keys with fewer rows than this are never worth the detour.
HOT_LEAST = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def unused(name: str, names: list[str]) -> str:
    """``name``, with a number if one of ``names`` is the same but for case."""
    taken, k, out = {x.lower() for x in names}, 0, name
    while out.lower() in taken:
        k, out = k + 1, f"{name}_{k + 1}"
    return out


def ddl_of(schema) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; in local mode the warehouse stands in for it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and spark.sparkContext.master.startswith("local["):
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarrylog"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def saved(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and lost executors cost nothing.

    Tables in ``done``, themselves made here, are deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    forget(*done)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made and nothing reads any more, and tell Spark to let go of shuffle files that nothing refers to."""
    for old in tables:
        spark = old.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(old._quarry_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys that hold more than one row in HOT_SHARE; at most HOT_SHARE of them by counting."""
    counts = saved(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(f"count >= {HOT_LEAST}"), "counts")
    total = rows.count()
    return [r[0] for r in counts.where(F.col("count") * HOT_SHARE > total).select(key).collect()]


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, whose ``key`` is unique, without sending a hot key's rows to one task.

    Rows of hot keys meet a broadcast of those keys' entries, at most HOT_SHARE
    of them; all other rows meet the table in an ordinary shuffled join.
    """
    hot = hot_keys(rows, key)
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (
        rows.where(~is_hot).join(table, key, how)
        .unionByName(rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(hot))), key, how))
    )
