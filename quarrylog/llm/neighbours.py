"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns unit vectors by rounds of random signs and fast Hadamard
transforms; its value is the signed axis that a vector then is nearest to.  A
table's bucket joins as many hashes, the last over fewer axes, as make about one
bucket for BUCKET vectors, so buckets grow in number and not in size.  A query
probes each table's buckets in the order of how near their axes are to it.  How
many is measured: the true neighbours of SAMPLE queries must lie in the probed
buckets with at least TARGET recall; as many other queries say what that is
worth.  Candidates are reranked by the exact cosine of the original vectors.

Vectors that differ by a power of two have equal cosines with all others and are
one class: all of its queries get one search, and its K + 1 smallest ids stand
for it as candidates, which loses nothing because they tie and ties go to
smaller ids.  Large buckets are divided into parts of about PART.  Vectors are
scaled by a power of two before they are multiplied, which changes no cosine and
lets no norm over- or underflow.

Defined results: vectors that are null, zero, or hold a null or non-finite
component, or whose id is null take no part; vectors of different sizes are no
neighbours, and each size is searched by itself; a repeated id counts once for
each different vector; candidates that tie all count, the smaller ids first;
queries with too few found search all buckets; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from xxhash import xxh3_128_digest

from .arrow import map_texts, schema_of
from .common import forget, lookup, saved

K, TABLES, ROUNDS, TARGET, SAMPLE = 5, 6, 3, 0.96, 128
#: Vectors a bucket on average, and buckets a table that a query may probe at most.
BUCKET, MOST_PROBES = 256, 2048
#: Candidates of a bucket that one task holds, queries that it scores at once, and how many more than wanted it looks at first.
PART, CHUNK, SPARE = 4096, 256, 6
#: Scores by matrix product are this near to the exact ones.
NEAR = 1e-9


class Tables:
    """Buckets of vectors of ``size`` components, of which there are ``n``."""

    def __init__(self, size: int, n: int, tables: int = TABLES, seed: int = 0):
        self.size, self.wide, self.tables = size, 1 << max(1, (size - 1).bit_length()), tables
        #: axes of each hash
        self.axes, buckets = [], max(2, n // BUCKET)
        while buckets > 1:
            self.axes.append(min(self.wide, 1 << max(0, (buckets - 1).bit_length() - 1)))
            buckets //= 2 * self.axes[-1]
        self.buckets = int(np.prod([2 * x for x in self.axes]))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.axes), ROUNDS, self.wide))

    def turned(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        """How near each row is to each signed axis of a table's k-th hash; the opposite axes follow after the others."""
        y = np.zeros((len(x), self.wide))
        y[:, : self.size] = x
        for signs in self.signs[table, k]:
            y *= signs
            step = 1
            while step < self.wide:
                halves = y.reshape(len(y), -1, 2, step)
                y = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(y), self.wide)
                step *= 2
        y = y[:, : self.axes[k]] / self.wide ** (ROUNDS / 2)
        return np.concatenate([y, -y], axis=1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, axes in enumerate(self.axes):
            out = out * 2 * axes + self.turned(x, table, k).argmax(axis=1)
        return out

    def order(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The first ``n`` buckets of each row, or all, nearest first: by the sum of squares of what their axes lack of the nearest."""
        cost, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for k, axes in enumerate(self.axes):
            y = self.turned(x, table, k)
            lack = (y.max(axis=1, keepdims=True) - y) ** 2
            first = np.argsort(lack, axis=1, kind="stable")[:, :n]
            cost = (cost[:, :, None] + np.take_along_axis(lack, first, 1)[:, None, :]).reshape(len(x), -1)
            key = (key[:, :, None] * 2 * axes + first[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :n]
            cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
        return key


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to at least a half and under one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def matrix(column: pa.Array, size: int, width: int) -> np.ndarray:
    return scaled(np.frombuffer(b"".join(column.to_pylist()), f"<f{width}").reshape(-1, size).astype(np.float64))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from the components in order, so equal vectors get equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(rows: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """vec_id, size, cls (hash of the direction) and the vector as little-endian floats of ``width`` bytes."""

    def make():
        def run(part):
            out = [[], [], [], []]
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0  # one zero
                if not np.isfinite(x).all() or not x.any():
                    continue
                for column, value in zip(out, (i, len(v), xxh3_128_digest(scaled(x[None])[0].tobytes()), x.astype(f"<f{width}").tobytes()), strict=True):
                    column.append(value)
            return out

        return run

    found = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    return map_texts(found, "vec_id long, size int, cls binary, v binary", make)


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each class, first within parts of a class, so no class is sorted in one task."""
    parts = rows.dropDuplicates(["vec_id", "cls"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["cls", "part"], ["cls"]):
        parts = parts.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(f"n <= {n}")
    return parts.select("vec_id", "cls", "v")


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q`` the n rows of ``x`` with the largest cosine, ties by id, and those cosines."""
    score, out = unit(q) @ unit(x).T, []
    keep = min(n + SPARE, score.shape[1])
    first = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < score.shape[1] else np.tile(np.arange(keep), (len(q), 1))
    for k, at in enumerate(first):
        own = np.sort(score[k, at])[::-1]
        if keep < score.shape[1] and own[-1] >= own[n - 1] - NEAR:
            at = np.flatnonzero(score[k] >= own[n - 1] - NEAR)  # more tie than were looked at
        exact = cosines(np.broadcast_to(q[k], (len(at), q.shape[1])), x[at])
        order = np.lexsort((ids[at], -exact))[:n]
        out.append((at[order], exact[order]))
    return out


def probes(members: DataFrame, queries: DataFrame, size: int, width: int, tables: Tables, k: int) -> tuple[int, float]:
    """Buckets a table to probe, from the true neighbours of SAMPLE queries among all members, and the recall that this gives as many others."""
    # at most 2 * SAMPLE vectors
    sample = queries.orderBy(F.xxhash64("cls", F.lit("sample")), "cls").limit(2 * SAMPLE).collect()
    if not sample:
        return 1, 1.0
    q = scaled(np.frombuffer(b"".join(r.v for r in sample), f"<f{width}").reshape(-1, size).astype(np.float64))
    own = [bytes(r.cls) for r in sample]
    given = members.sparkSession.sparkContext.broadcast((unit(q), own))

    def make():
        asked, own = given.value
        best: list[list] = [[] for _ in own]

        def run(part):
            x = unit(matrix(part.column(1), size, width))
            score = asked @ x.T
            where: dict[bytes, list[int]] = {}
            for at, c in enumerate(part.column(0).to_pylist()):
                where.setdefault(c, []).append(at)
            for i, c in enumerate(own):
                score[i, where.get(c, [])] = -2.0
            n = min(k, score.shape[1])
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            used, back = np.unique(at, return_inverse=True)
            places = np.array([tables.bucket(x[used], t) for t in range(tables.tables)]).T[back.reshape(at.shape)]
            for i, row in enumerate(at):
                best[i] = sorted(best[i] + [(float(score[i, j]), places[i, r].tolist()) for r, j in enumerate(row)], reverse=True)[:k]
            return [[], [], []]

        def rest():
            flat = [(i, s, b) for i, rows in enumerate(best) for s, b in rows if s > -2]
            return [[i for i, _, _ in flat], [s for _, s, _ in flat], [b for _, _, b in flat]]

        run.rest = rest
        return run

    near = map_texts(members.select("cls", "v"), "i int, score double, buckets array<long>", make)
    # 2 * SAMPLE * k rows
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).where(f"r <= {k}").collect()
    if not true:
        return 1, 1.0
    orders = [tables.order(q, t, min(MOST_PROBES, tables.buckets)) for t in range(tables.tables)]
    needed = np.array([min((int(at[0]) for o, b in zip(orders, row.buckets, strict=True) if len(at := np.flatnonzero(o[row.i] == b))), default=MOST_PROBES) for row in true])
    fit = np.array([row.i % 2 == 0 for row in true])
    fit = fit if fit.any() and not fit.all() else np.ones(len(true), bool)
    n = int(np.sort(needed[fit])[int(np.ceil(TARGET * fit.sum())) - 1]) + 1
    checked = needed[~fit] if not fit.all() else needed
    return min(n, tables.buckets, MOST_PROBES), float((checked < n).mean())


def searched(members: DataFrame, queries: DataFrame, size: int, width: int, tables: Tables, n_probes: int | None, k: int) -> DataFrame:
    """cls of the query, vec_id and score: the best k + 1 of each probed part of a bucket; all members of the first table without ``n_probes``."""
    use, every = (tables.tables, False) if n_probes else (1, True)

    def index():
        def run(part):
            x = unit(matrix(part.column(1), size, width))
            n = len(x)
            keys = [np.zeros(n, np.int64)] if every else [tables.bucket(x, t) * tables.tables + t for t in range(use)]
            return [pa.array(np.concatenate(keys)), pa.array(np.tile(part.column(0).to_numpy(), use)), part.column(1).take(pa.array(np.tile(np.arange(n), use)))]

        return run

    def probe():
        def run(part):
            x = unit(matrix(part.column(1), size, width))
            at = np.zeros((len(x), 1), np.int64) if every else np.concatenate([tables.order(x, t, n_probes) * tables.tables + t for t in range(use)], axis=1)
            which = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
            return [pa.array(at.reshape(-1)), part.column(0).take(which), part.column(1).take(which)]

        return run

    indexed = map_texts(members.select("vec_id", "v"), "key long, vec_id long, v binary", index)
    sizes = saved(indexed.groupBy("key").count().select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "bucket-sizes")
    large = saved(sizes.where("parts > 1"), "large-buckets")
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")
    held = (lookup(indexed, large, "key", "left") if not large.isEmpty() else indexed.withColumn("parts", F.lit(1))).select("key", part.alias("part"), F.lit(0).alias("tag"), "vec_id", F.lit(None).cast("binary").alias("cls"), "v")
    asked = lookup(map_texts(queries.select("cls", "v"), "key long, cls binary, v binary", probe), sizes, "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("tag"), F.lit(None).cast("long").alias("vec_id"), "cls", "v")

    def score(batches):
        key, ids, held, waiting, x = None, [], [], [], None

        def answered():
            nonlocal x
            if x is None:
                x = matrix(pa.array(held, pa.binary()), size, width)
            found = nearest(matrix(pa.array([v for _, v in waiting], pa.binary()), size, width), x, np.array(ids, np.int64), k + 1)
            names = [c for (c, _), (at, _) in zip(waiting, found, strict=True) for _ in at]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([ids[j] for at, _ in found for j in at.tolist()], pa.int64()), pa.array(np.concatenate([s for _, s in found]))], names=["cls", "vec_id", "score"])

        for batch in batches:
            for b, s, tag, i, cls, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, s) != key:
                    if waiting and held:
                        yield answered()
                    key, ids, held, waiting, x = (b, s), [], [], [], None
                if tag == 0:
                    ids.append(i)
                    held.append(v)
                else:
                    waiting.append((cls, v))
                    if len(waiting) >= CHUNK and held:
                        yield answered()
                        waiting = []
        if waiting and held:
            yield answered()

    return held.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", "tag").mapInArrow(score, schema_of("cls binary, vec_id long, score double"))


def best(found: DataFrame, n: int) -> DataFrame:
    """The n best different ids of each cls, with their rank."""
    order = Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("cls", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(f"rank <= {n}")


def of_size(every: DataFrame, size: int, width: int, is_query: str, k: int) -> DataFrame:
    """The neighbours among vectors of one size."""
    members = saved(smallest(every, k + 1), "candidates")
    asking = saved(every.where(is_query).select(F.col("vec_id").alias("query_id"), "cls").distinct(), "queries")
    queries = saved(every.where(is_query).groupBy("cls").agg(F.first("v").alias("v")), "query-classes")
    n_members = members.count()
    tables = Tables(size, n_members)
    n_probes, _ = probes(members, queries, size, width, tables, k)
    found = saved(best(searched(members, queries, size, width, tables, n_probes, k), k + 1), "found")
    enough = found.groupBy("cls").count().where(F.col("count") >= min(k + 1, n_members)).select("cls")
    lacking = saved(queries.join(enough, "cls", "left_anti"), "lacking")
    if not lacking.isEmpty():
        more = best(searched(members, lacking, size, width, tables, None, k), k + 1)
        found = found.join(lacking.select("cls"), "cls", "left_anti").unionByName(more)
    answers = saved(found.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")), "answers")
    each = lookup(asking, answers, "cls").select("query_id", F.explode(F.slice(F.expr("filter(near, x -> x.vec_id <> query_id)"), 1, k)).alias("x"))
    forget(members, queries)
    # the rank among those left, from the rank before
    order = Window.partitionBy("query_id").orderBy("x.rank")
    return each.select("query_id", F.row_number().over(order).alias("rank"), "x.vec_id", "x.score")


def neighbours(rows: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows of which the SQL condition ``is_query`` over vec_id holds."""
    kind = rows.schema[vector_col].dataType
    width = 4 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else 8
    every = saved(usable(rows, id_col, vector_col, width), "vectors")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # as many rows as vectors have different sizes, of which only those that queries have are searched
    for size in sorted(r["size"] for r in every.where(is_query).select("size").distinct().collect()):
        out = out.unionByName(of_size(every.where(F.col("size") == size), size, width, is_query, k))
    return out


def op9_neighbours(spark, sf_dir):
    """query_id, rank, vec_id and score: the 5 nearest found of each row of ``embeddings`` whose vec_id is divisible by 50."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id % 50 = 0")
