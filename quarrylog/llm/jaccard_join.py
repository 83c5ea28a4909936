"""N-gram Jaccard join as a metric-space join.

The Jaccard distance of shingle sets is a metric, and a link is a distance of
at most EPSILON.  Texts of a corpus are nearly all at distance one from each
other, where no pivot tells them apart and every window holds everything.  So
first the sets that can't have a link are put aside, and the others are dealt
into blocks that are more than EPSILON apart, both by exact bounds on shared
shingles (``prefix``); README.md has the shares.  That finds no pair: every link
is the measured distance between a pivot and a set.

A block is joined by pivots.  Pivots are sets far from each other, outside the
block's largest component; their distances to all sets of the block are
measured, which settles all their own links, so they are done.  Each other set
goes to its nearest pivot's Voronoi region, or to the outer region if that is
farther than 2 EPSILON.  By the triangle inequality a set linked with x, whose
home is p, has d(y, p) <= 3 EPSILON and d(y, p) <= d(y, home) + 2 EPSILON, so
sets in that window are copied to p's region; the outer region needs no copies,
since a pair with an inner set meets in that set's region.  Regions are joined
recursively and exactly until all of a region's sets are in
one component; regions that overlap so much that together they cost fewer
distances are joined together.  A block with more shingles than a task holds is
divided the same way by tasks that measure a part of it each; regions that
don't get smaller so are compared part by part, where triangle-inequality
windows on the pivots' distances leave a pair possible.

Equal sets are one class from the first.  Shingles are 64-bit hashes, classes
128-bit hashes of the sorted shingles.

Defined results: a null, empty or blank text has no shingles and is linked with
nothing; a row with a null doc_id is in the component of an equal text, or in
none (null), and links nothing; rows that share a doc_id are linked through it
only if their texts are; repeated rows have equal results; sets at exactly the
threshold are linked; an empty table gives an empty result; extra columns are
ignored, whatever their names; a very long text is one set, whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .arrow import map_texts, schema_of
from .common import HOT_LEAST, documents, forget, lookup, quoted, saved
from .components import components

WORDS = 5
#: A link: 100 * |x & y| >= PERCENT * |x | y|.
PERCENT = 75
EPSILON = 1 - PERCENT / 100
#: Shingles of a block that one task holds; a larger block is measured in parts of as many.
BLOCK = 400_000
PIVOTS = 4
#: Shingles in more than one class of COMMON come last in the order; at most COMMON times the mean set are.
COMMON, MAX_COMMON = 1000, 1 << 20
#: Bits of the map that keeps most texts without a possible link from being shuffled; a full map only keeps none.
BITS = 1 << 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted different shingles of a text; bytes.lower and bytes.split know ASCII only."""
    tokens = (raw or b"").lower().split()
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([xxh3_64_intdigest(b" ".join(tokens), seed=n)], np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, n)
    out = each[: n - words + 1].copy()
    for k in range(1, words):
        out *= MULTIPLIER
        out ^= out >> np.uint64(31)
        out += each[k : n - words + 1 + k]
    out *= MULTIPLIER
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(x: np.ndarray) -> bytes:
    return xxh3_128_digest(x.tobytes())


def node_of(cls: bytes) -> int:
    """Eight bytes of a class, for looking for candidates only."""
    return int.from_bytes(cls[:8], "little", signed=True)


def extra(n: int) -> int:
    return n // 9


def prefix(n: int) -> int:
    """How many first shingles name the regions of a set of n.

    A linked pair has at least q(max(n, m)) common shingles, q(n) =
    ceil(PERCENT n / 100).  Those after the earlier of the two prefixes' ends
    are at most n - prefix(n) = q(n) - 1 - extra(n) of that set, so at least
    extra(n), and at least one, lie in both prefixes.
    """
    return n - -(-PERCENT * n // 100) + 1 + extra(n)


class Forest:
    """Components of a few sets by number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Block:
    """Sets by number, with their shingles in one order, so that a set's distances to all others are looked up at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array(list(map(len, sets)), np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def measured(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance of ``x`` to each set, and whether they are linked."""
        lo, hi = np.searchsorted(self.tokens, x, "left"), np.searchsorted(self.tokens, x, "right")
        n = hi - lo
        both = np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(self.sets))
        union = len(x) + self.sizes - both
        return 1 - both / union, 100 * both >= PERCENT * union


def join_block(sets: list[np.ndarray], tally: Counter | None = None) -> list[int]:
    """The component of each set, as the number of its first member; ``tally`` counts regions, divisions and distances."""
    forest, block, work = Forest(len(sets)), Block(sets), [np.arange(len(sets))]
    tally = Counter() if tally is None else tally
    while work:
        items = work.pop()
        roots = np.array([forest.root(i) for i in items.tolist()])
        names, counts = np.unique(roots, return_counts=True)
        if len(names) == 1:
            continue
        # what is in the largest component already is no pivot
        outside = items[roots != names[counts.argmax()]] if counts.max() > 1 else items
        pivots, rows = [int(outside[0])], []
        while True:
            d, near = block.measured(sets[pivots[-1]])
            rows.append(d[items])
            for i in items[near[items]].tolist():
                forest.join(pivots[-1], i)
            far = np.min([r[np.isin(items, outside)] for r in rows], axis=0)
            if len(rows) == PIVOTS or far.max() <= EPSILON:
                break
            pivots.append(int(outside[far.argmax()]))
        tally.update(regions=1, distances=len(rows) * len(items))
        rest = ~np.isin(items, pivots)
        parts = divided(np.array(rows)[:, rest])
        tally.update(divisions=len(parts) > 1)
        work += [items[rest][part] for part in parts if part.sum() > 1]
    return [forest.root(i) for i in range(len(sets))]


def divided(d: np.ndarray) -> list[np.ndarray]:
    """Voronoi regions with their boundaries, as masks, of the distances from pivots (rows) to sets (columns); the outer region comes last."""
    if not d.shape[1]:
        return []
    nearest, slack = d.min(axis=0), 1e-9
    inner = nearest <= 2 * EPSILON + slack
    homes = np.unique(d[:, inner].argmin(axis=0)) if inner.any() else []
    out = [d[k] <= np.minimum(3 * EPSILON, nearest + 2 * EPSILON) + slack for k in homes]
    if not inner.all():
        out.append(~inner)
    cost = lambda m: int(m.sum()) ** 2
    k = 0
    while k < len(out):
        # two regions that cost as much apart as together are one
        other = next((j for j in range(len(out)) if j != k and cost(out[j] | out[k]) <= cost(out[j]) + cost(out[k])), None)
        if other is None:
            k += 1
            continue
        both = out[k] | out[other]
        out = [m for j, m in enumerate(out) if j not in (k, other)] + [both]
        k = 0
    return out if sum(map(cost, out)) <= d.shape[1] ** 2 else [np.ones(d.shape[1], bool)]


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls and node of every row; with them, per task, the shingles that many of its classes share (``token``, ``seen``)."""

    def make():
        seen_classes: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> dict[int, int]:
            nonlocal size
            if not held:
                return {}
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(8, len(held) // 256)
            out = dict(zip(tokens[many].view(np.int64).tolist(), n[many].tolist(), strict=True))
            held.clear()
            size = 0
            return out

        def rows(ids, ns, cs, tokens):
            k, m = len(ns), len(tokens)
            nodes = [None if c is None else node_of(c) for c in cs]
            return [ids + [None] * m, ns + [None] * m, cs + [None] * m, nodes + [None] * m, [None] * k + list(tokens), [None] * k + list(tokens.values())]

        def run(part):
            nonlocal size
            ns, cs = [], []
            for raw in part.column(1).cast("binary").to_pylist():
                x = shingles(raw)
                cls = class_of(x) if len(x) else None
                ns.append(len(x))
                cs.append(cls)
                if cls and cls not in seen_classes:
                    seen_classes.add(cls)
                    held.append(x)
                    size += len(x)
            tokens = frequent() if size > 4_000_000 else {}
            if tokens:
                seen_classes.clear()
            return rows(part.column(0).to_pylist(), ns, cs, tokens)

        run.rest = lambda: rows([], [], [], frequent())
        return run

    return map_texts(docs.select("doc_id", "text"), "doc_id long, n long, cls binary, node long, token long, seen long", make)


def regions(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, node, n, hot): each class once a task in the regions of its prefix; frequent shingles come last in the order."""
    given = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        last, done = given.value, set()

        def run(part):
            tokens, nodes, sizes, hots = [], [], [], []
            for raw in part.column(0).cast("binary").to_pylist():
                x = shingles(raw)
                if not len(x) or (cls := class_of(x)) in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(cls)
                hot = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x if len(last) else np.zeros(len(x), bool)
                take = np.argsort(hot, kind="stable")[: prefix(len(x))]
                tokens.append(x[take].view(np.int64))
                hots.append(hot[take])
                nodes.append(np.full(len(take), node_of(cls)))
                sizes.append(np.full(len(take), len(x), np.int32))
            if not tokens:
                return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.bool_())]
            return [pa.array(np.concatenate(c)) for c in (tokens, nodes, sizes, hots)]

        return run

    return map_texts(docs.select("text"), "token long, node long, n int, hot boolean", make, 0)


def survivors(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """node: the classes that share enough of their first shingles with others to have a link.

    The rows of a frequent shingle aren't gathered: it counts as shared.
    """
    rows = regions(docs, frequent).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(1009))).otherwise(0))
    region = Window.partitionBy("token", "salt")
    met = rows.withColumns({"lo": F.min("node").over(region), "hi": F.max("node").over(region)}).where("hot or lo < hi").select("token", "node", "n")
    # a class that several tasks have sends a shingle more than once
    counted = met.repartition("node").groupBy("node", "n", "token").agg(F.first("n").alias("x")).groupBy("node", "n").agg(F.count(F.lit(1)).alias("regions"))
    return saved(counted.where("regions >= greatest(1, n div 9)").select("node").distinct(), "survivors")


def having(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with a doc_id that may be in ``ids`` (first): a map of BITS bits meets them, BITS / 64 rows at most."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = ids.select(bit("first").alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    met = docs.withColumn("b", bit("doc_id")).join(F.broadcast(words), F.expr("b div 64") == F.col("word"))
    return met.where("getbit(bits, cast(b % 64 as int)) = 1").select(*docs.columns)


def blocks(members: DataFrame) -> DataFrame:
    """node and block of MEMBERS: sets that could be linked, by any chain of regions of the second order, are in one block.

    A shingle is in at most as many rows as there are sets, so no region is
    more than a mean set's share of all rows.
    """

    def make():
        def run(part):
            sets = [numbers(raw) for raw in part.column(1).to_pylist()]
            sizes = list(map(len, sets))
            nodes = np.array([node_of(c) for c in part.column(0).to_pylist()], np.int64)
            return [pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(np.array(sizes, np.int32), sizes))]

        return run

    rows = map_texts(members.select("cls", "shingles"), "token long, node long, n int", make)
    counted = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    # a set's own shingles come first: only those that others have too are listed
    listed = counted.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    first = f"n - ceil({PERCENT} * n / 100) + 1 + n div 9 - (n - size(own))"
    cut = listed.withColumn("k", F.expr(f"cast({first} as int)")).where("k >= greatest(1, n div 9)")
    cut = saved(cut.select("node", "n", F.explode(F.expr("slice(own, 1, k).token")).alias("token")), "second-regions")
    least = saved(cut.groupBy("token").agg(F.min("node").alias("p"), F.max("node").alias("hi")).where("p < hi").select("token", "p"), "least-holders")
    met = lookup(cut, least, "token").withColumn("regions", F.count(F.lit(1)).over(Window.partitionBy("node"))).where("regions >= greatest(1, n div 9)")
    found = components(met.where("node > p").select(F.col("node").alias("a"), F.col("p").alias("b")))
    forget(cut, least)
    return found.select("node", F.col("root").alias("block"))


def numbers(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


MEMBERS = "cls binary, shingles binary"


def small_blocks(rows: DataFrame) -> DataFrame:
    """cls and root (a cls) of MEMBERS rows whose blocks have BLOCK shingles at most."""

    def run(batches):
        block, names, sets = None, [], []

        def solved():
            # equal rows may come more than once
            own = dict(zip(names, sets, strict=True))
            keys = sorted(own)
            roots = join_block([own[k] for k in keys])
            out = [(k, keys[r]) for k, r in zip(keys, roots, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["cls", "root"])

        for batch in batches:
            for b, cls, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != block and names:
                    yield solved()
                    names, sets = [], []
                block = b
                names.append(cls)
                sets.append(numbers(raw))
        if names:
            yield solved()

    return rows.select("block", "cls", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(run, schema_of("cls binary, root binary"))


def grouped(rows: DataFrame, keys: list[str], ddl: str, function) -> DataFrame:
    """``function(key, pivots, members)`` for each key of rows sorted so that those with tag 0 come first; yields record batches."""
    width = len(keys)

    def run(batches):
        key, first, members = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != key:
                    if first and members:
                        yield from function(key, first, members)
                    key, first, members = row[:width], [], []
                (members if row[width] else first).append(row[width + 1 :])
        if first and members:
            yield from function(key, first, members)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "tag").mapInArrow(run, schema_of(ddl))


def parted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (block, cls, ...) with ``parts`` of their block, of about BLOCK shingles each, and a ``part``."""
    known = saved(sizes.withColumn("parts", F.ceil(F.col("shingle_count") / BLOCK).cast("int")), "block-parts")
    return lookup(rows, known, "block").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))


def sized(rows: DataFrame, *more) -> DataFrame:
    return rows.groupBy("block").agg(F.sum(F.length("shingles") / 8).cast("long").alias("shingle_count"), *more)


def large_blocks(rows: DataFrame) -> DataFrame:
    """Links (a, b), as cls, that make the components of blocks (block, cls, shingles) with more than BLOCK shingles.

    Parts are first joined each by itself.  Each round then measures all sets of
    a block against its pivots, in parts, and deals them to regions.  Regions
    that fit a task are joined there; larger ones are blocks of the next round,
    as long as they get smaller or more of their sets come into one component.
    """
    rows = saved(rows, "large-blocks")
    sizes = saved(sized(rows, F.count(F.lit(1)).alias("left")), "block-sizes")
    rows = saved(parted(rows, sizes), "large-blocks", rows)
    links = [saved(small_blocks(rows.withColumn("block", F.xxhash64("block", "part"))).where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "part-links")]
    labels = components(links[0])
    rows = saved(rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("block", "cls", "shingles", F.coalesce("root", "cls").alias("root"), "left"), "large-blocks", rows, labels)
    while not rows.isEmpty():
        sizes = saved(sized(rows), "block-sizes")
        rows = saved(parted(rows, sizes), "large-blocks", rows)
        measured = saved(measure(rows), "measured")
        links.append(measured.select(F.col("cls").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        labels = components(every)
        known = rows.drop("root").join(measured.where("not is_pivot").select("block", "cls", "far"), ["block", "cls"]).join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # bit k: the region of pivot k; the last bit: the outer region
        inner = f"filter(sequence(0, size(far) - 1), k -> far[k] <= least({3 * EPSILON}, array_min(far) + {2 * EPSILON}) + 1e-9)"
        outer = f"if(array_min(far) > {2 * EPSILON} + 1e-9, {1 << 2 * PIVOTS}, 0)"
        masked = saved(known.withColumn("mask", F.expr(f"aggregate({inner}, {outer}, (m, k) -> m | shiftleft(1, k))")), "masked", rows, labels)
        dealt = lookup(masked, saved(merged(masked), "merged"), "block").withColumn("k", F.explode(F.expr("filter(merged, m -> (m & mask) <> 0)")))
        dealt = saved(dealt.select(F.xxhash64("block", "k").alias("block"), "cls", "shingles", "far", "root", "parts", "left"), "regions", masked)
        now = saved(
            dealt.groupBy("block", "root", "parts", "left").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("shingles")).alias("bytes"))
            .groupBy("block").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"), (F.sum("bytes") / 8).cast("long").alias("shingle_count"), F.max("parts").alias("before"), F.max("left").alias("left")).where("most < all"),
            "region-sizes",
        )
        fits, smaller = F.col("shingle_count") <= BLOCK, (F.ceil(F.col("shingle_count") / BLOCK) <= 0.75 * F.col("before")) | (F.col("all") - F.col("most") <= 0.75 * F.col("left"))
        inside = dealt.join(now.where(fits).select("block"), "block", "left_semi")
        links.append(saved(small_blocks(inside).where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "region-links"))
        links.append(saved(tiled(dealt.drop("parts", "left"), now.where(~fits & ~smaller)), "tile-links"))
        rows = saved(dealt.drop("left").join(now.where(~fits & smaller).select("block", (F.col("all") - F.col("most")).alias("left")), "block").select("block", "cls", "shingles", "root", "left"), "large-blocks", dealt)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every


def merged(masked: DataFrame) -> DataFrame:
    """block and the regions ``merged`` of its rows (block, mask), each as the bits of the regions that are one: those that overlap so much that they cost no more together, as ``divided`` has it."""

    def run(batches):
        for batch in batches:
            blocks, out = batch.column(0).to_pylist(), []
            for own in batch.column(1).to_pylist():
                masks, n = np.array([x["mask"] for x in own]), np.array([x["n"] for x in own], float)
                cost = lambda m: n[masks & m != 0].sum() ** 2
                parts = [1 << k for k in range(2 * PIVOTS + 1) if cost(1 << k)]
                while pair := next(((a, b) for i, a in enumerate(parts) for b in parts[i + 1 :] if cost(a | b) <= cost(a) + cost(b)), None):
                    parts = [m for m in parts if m not in pair] + [pair[0] | pair[1]]
                whole = (1 << 2 * PIVOTS + 1) - 1
                out.append(parts if sum(map(cost, parts)) <= cost(whole) else [whole])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["block", "merged"])

    counts = masked.groupBy("block", "mask").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("block").agg(F.collect_list(F.struct("mask", "n")).alias("own")).mapInArrow(run, schema_of("block long, merged array<int>"))


def measure(rows: DataFrame) -> DataFrame:
    """block, cls, is_pivot, distances ``far`` to the block's pivots and the pivots ``near`` enough to be linked with.

    Pivots are taken by hash, first among the sets outside the block's largest component.
    """
    counts = rows.groupBy("block", "root").agg(F.count(F.lit(1)).alias("k"))
    main = saved(counts.groupBy("block").agg(F.max_by("root", F.struct("k", "root")).alias("main")), "main-components")
    order = F.struct((F.col("root") == F.col("main")).alias("inside"), F.xxhash64("cls", F.lit("order")).alias("h"))
    slot = lookup(rows, main, "block").withColumn("j", F.pmod(F.xxhash64("cls", F.lit("pivot")), F.lit(2 * PIVOTS)))
    pivot = saved(slot.groupBy("block", "parts", "j").agg(F.min_by(F.struct("cls", "shingles"), order).alias("p")), "pivots")
    tagged = (
        pivot.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("tag"), F.col("p.cls").alias("cls"), F.col("p.shingles").alias("shingles"))
        .unionByName(rows.select("block", "part", F.lit(1).alias("tag"), "cls", "shingles"))
    )

    def run(key, pivots, members):
        pivots = sorted(pivots)
        names, sets = [c for c, _ in members], Block([numbers(raw) for _, raw in members])
        found = [sets.measured(numbers(raw)) for _, raw in pivots]
        own = [c for c, _ in pivots]
        far = np.array([d for d, _ in found]).T
        near = [[own[k] for k in np.flatnonzero(x).tolist()] for x in np.array([x for _, x in found]).T]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(names), pa.int64()), pa.array(names, pa.binary()), pa.array([c in own for c in names]), pa.array(far.tolist(), pa.list_(pa.float64())), pa.array(near, pa.list_(pa.binary()))], names=["block", "cls", "is_pivot", "far", "near"])

    return grouped(tagged, ["block", "part"], "block long, cls binary, is_pivot boolean, far array<double>, near array<binary>", run)


def tiled(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Links (a, b) of regions that pivots don't divide: the sets outside the largest component with all others, part by part."""
    known = lookup(parted(rows, regions.select("block", "shingle_count")), regions.select("block", "main", F.ceil((F.col("all") - F.col("most")) * F.col("shingle_count") / F.col("all") / BLOCK).cast("int").alias("chunks")), "block")
    columns = [F.col(c) for c in ("cls", "shingles", "far", "root")]
    outside = known.where("root <> main").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit("chunk")), F.col("chunks")).cast("int"))
    tiles = (
        outside.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", F.lit(0).alias("tag"), *columns)
        .unionByName(known.select("block", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("tag"), *columns))
    )

    def run(key, own, others):
        block, far = Block([numbers(raw) for _, raw, _, _ in others]), np.array([d for _, _, d, _ in others])
        out = []
        for cls, raw, d, root in own:
            window = (np.abs(far - np.array(d)) <= EPSILON + 1e-9).all(axis=1)
            met = {root}
            for k in np.flatnonzero(block.measured(numbers(raw))[1] & window).tolist():
                if others[k][3] not in met:
                    met.add(others[k][3])
                    out.append((cls, others[k][0]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

    return grouped(tiles, ["block", "part", "chunk"], "a binary, b binary", run)


def joined(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; only of those whose doc_id ``among`` has, if given."""
    docs = docs.select("doc_id", "text")
    made = saved(classes(docs), "classes")
    rows = made.where("n is not null").select("doc_id", "n", "cls", "node")
    if among is not None:
        rows = saved(rows.join(among.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "rows")
    by_class = saved(rows.where("cls is not null").groupBy("cls", "node").agg(F.min("doc_id").alias("first")), "class-members")
    often = made.where("token is not null").groupBy("token").agg(F.sum("seen").alias("n")).where(F.col("n") >= max(HOT_LEAST, by_class.count() // COMMON))
    # at most MAX_COMMON numbers, whatever the corpus
    frequent = np.sort(often.orderBy(F.desc("n"), "token").limit(MAX_COMMON).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64))
    able = survivors(docs, frequent)
    mine = saved(by_class.join(able.hint("merge"), "node", "left_semi").select("first", "cls").where("first is not null"), "surviving-classes", able)
    texts = having(docs, mine).join(mine.withColumnRenamed("first", "doc_id").hint("merge"), "doc_id").select("cls", "text")

    def make():
        def run(part):
            sets = [shingles(raw) for raw in part.column(1).cast("binary").to_pylist()]
            # another row may share the doc_id
            keep = [class_of(x) == c for x, c in zip(sets, part.column(0).to_pylist(), strict=True)]
            return [part.column(0).filter(pa.array(keep, pa.bool_())), [x.tobytes() for x, k in zip(sets, keep, strict=True) if k]]

        return run

    gathered = saved(map_texts(texts, MEMBERS, make), "sets", mine)
    found = saved(blocks(gathered), "blocks")
    members = saved(with_node_sets(gathered).join(found.hint("merge"), "node").select("block", "cls", "shingles"), "block-sets", gathered, found)
    sizes = saved(sized(members), "block-sizes")
    # not many: each has more than BLOCK shingles
    large = sizes.where(f"shingle_count > {BLOCK}").select("block")
    roots = small_blocks(members.join(large, "block", "left_anti"))
    if not large.isEmpty():
        roots = roots.unionByName(components(large_blocks(members.join(large, "block", "left_semi"))).withColumnsRenamed({"node": "cls"}))
    roots = saved(roots, "roots", members, sizes)
    labelled = saved(by_class.join(roots.hint("merge"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "first"), "class-roots", by_class, roots)
    first = saved(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    final = saved(lookup(labelled.select("cls", "root"), first, "root").select("cls", "component_id"), "class-components", labelled, first)
    result = lookup(rows.where("cls is not null"), final, "cls").unionByName(rows.where("cls is null").withColumn("component_id", F.col("doc_id")))
    return result.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def with_node_sets(rows: DataFrame) -> DataFrame:
    """MEMBERS rows with their node."""

    def make():
        return lambda part: [part.column(0), part.column(1), [node_of(c) for c in part.column(0).to_pylist()]]

    return map_texts(rows.select("cls", "shingles"), f"{MEMBERS}, node long", make)


def representatives(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``docs`` without the documents that are linked to one with a smaller doc_id; rows with a null doc_id stay.

    With ``texts`` (doc_id, text), documents are compared by their texts there;
    those that it hasn't stay.
    """
    found = joined(docs) if texts is None else joined(texts, docs)
    # a row that shares its doc_id with another group's first may stay; so may equal rows
    gone = found.where("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    if texts is None:
        gone = gone.join(found.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    gone = saved(gone, "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op10_jaccard_join(spark, sf_dir):
    """doc_id, n_shingles and component_id of every whole text of ``documents``."""
    return joined(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
