"""Packing of documents into sequences: a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  The
program chooses how often to use each so that all pieces are covered with the
fewest sequences.  It sees only the histogram of lengths, so its size depends
on the capacity and not on the corpus.  Multiplicative weights solve it: prices
per length, a knapsack dynamic program that finds the most valuable
configuration of the pieces there are, and prices that fall as a length is
covered, until all are covered and the prices prove the answer near the best.
Uses are whole; the pieces of configurations that are not full enough are packed
best fit, longest first.

Defined results: a null or empty text is the end id alone; a null doc_id passes
through; repeated rows are packed each; an empty table gives no pieces; extra
columns are ignored, whatever their names; a very long text is cut into whole
sequences after a first piece of what is left over; pieces of equal length are
placed in the order of the tasks that made them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_texts
from .chunks import ROWS
from .common import documents, saved
from .library_tokens import batch_ids, byte_level

CAPACITY = 2048
#: How fast prices fall, and how far from the bound the program may end.
RATE, GAP = 0.5, 1 / 256
#: Shares of the capacity that a configuration may leave empty and still be used; the fewest sequences are taken, of equals the first.
SLACKS = (1.0, 1 / 8, 1 / 64, 0.0)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def knapsack(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The most valuable multiset of at most ``counts`` pieces within ``capacity``, index -> times, and its value; the longest of equals."""
    density = prices / lengths
    order = np.lexsort((-lengths, -density.round(12)))
    best, free = np.zeros(capacity + 1), np.arange(capacity, -1, -1)
    items, took = [], []
    for i, k in enumerate(order.tolist()):
        # whatever the rest may add is worth its density for each free place at most
        if i % 8 == 0 and (best + free * density[k]).max() <= best[capacity] * (1 + 1e-9):
            break
        size, left, some = int(lengths[k]), min(int(counts[k]), capacity // int(lengths[k])), 1
        while left:
            n = min(some, left)
            left, some = left - n, 2 * some
            value = best[: -n * size] + n * prices[k]
            # sums in another order are no gain
            better = value > best[n * size :] + 1e-12
            items.append((k, n))
            took.append(better)
            best[n * size :][better] = value[better]
    room, times = capacity, Counter()
    for (k, n), better in zip(reversed(items), reversed(took), strict=True):
        used = n * int(lengths[k])
        if used <= room and better[room - used]:
            times[k] += n
            room -= used
    return dict(times), float(best[capacity])


def covering(lengths: np.ndarray, counts: np.ndarray, capacity: int, prices: np.ndarray, rate: float = RATE) -> dict[tuple, int]:
    """Configurations, as sorted (index, times) pairs, and how often to use each, until every piece is covered.

    A configuration holds no more of a length than is left and is used as often
    as its scarcest length allows; a price falls with the share covered.
    """
    prices, left, used = prices.copy(), counts.copy(), Counter()
    while (live := np.flatnonzero(left)).size:
        times, _ = knapsack(lengths[live], prices[live], left[live], capacity)
        at, n = live[np.fromiter(times, int)], np.fromiter(times.values(), int)
        amount = int((left[at] // n).min())
        used[tuple(sorted(zip(at.tolist(), n.tolist(), strict=True)))] += amount
        left[at] -= amount * n
        prices[at] *= np.exp(-rate * amount * n / counts[at])
    return dict(used)


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple, int], float]:
    """The best covering and a lower bound of its sequences.

    Any prices bound the program from below: what all pieces cost over the most
    valuable configuration.  Prices begin at the sizes and grow by what the
    configurations of a length leave empty, until the bound is within GAP of the
    covering or neither comes nearer by as much.
    """
    prices, best, fewest, bound = lengths / capacity, None, 0, 0.0
    while True:
        below = float(prices @ counts) / knapsack(lengths, prices, counts, capacity)[1]
        used = covering(lengths, counts, capacity, prices)
        n = sum(used.values())
        nearer = best is None or n * (1 + GAP) <= fewest or below >= bound * (1 + GAP)
        if best is None or n < fewest:
            best, fewest = used, n
        bound = max(bound, below)
        if not nearer or fewest <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)):
            return best, bound
        paid = np.zeros(len(lengths))
        for made, times in used.items():
            size = sum(int(lengths[k]) * n for k, n in made)
            for k, n in made:
                paid[k] += times * n * capacity / size
        prices = prices * paid / counts


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that has room; equal sequences are handled as one entry."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [configuration, how many]
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[k]), int(counts[k])
        while left:
            room = min((r for r, found in open_.items() if r >= size and found), default=None)
            if room is None:
                each = min(capacity // size, left)
                n = left // each
                open_[capacity - each * size].append([(size,) * each, n])
                left -= n * each
                continue
            made, n = open_[room].pop()
            take = min(n, left)
            if n > take:
                open_[room].append([made, n - take])
            open_[room - size].append([(*made, size), take])
            left -= take
    return [(made, n) for found in open_.values() for made, n in found]


def rounded(solution: dict[tuple, int], lengths: np.ndarray, counts: np.ndarray, capacity: int, slack: float) -> list[tuple[tuple[int, ...], int]]:
    """The solution's configurations that leave at most ``slack`` of a sequence empty, fullest first; the rest best fit."""
    left, out = counts.copy(), []
    size = {c: sum(int(lengths[k]) * n for k, n in c) for c in solution}
    for made in sorted(solution, key=lambda c: -size[c]):
        times = min([int(solution[made]), *(int(left[k]) // n for k, n in made)])
        if times and capacity - size[made] <= slack * capacity:
            for k, n in made:
                left[k] -= n * times
            out.append((tuple(int(lengths[k]) for k, n in reversed(made) for _ in range(n)), times))
    rest = left > 0
    return out + best_fit(lengths[rest], left[rest], capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths in order) and how many sequences take each; they hold every piece once."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths.tolist()])
    solution, _ = solved(lengths, counts, capacity)
    return min((rounded(solution, lengths, counts, capacity, x) for x in SLACKS), key=lambda p: sum(n for _, n in p))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> for its k-th piece: first k of each entry, the entry's first sequence, its times of the length, and their offsets."""
    found: dict[int, list] = defaultdict(list)
    sequence = 0
    for made, n in planned:
        offsets = defaultdict(list)
        at = 0
        for x in made:
            offsets[x].append(at)
            at += x
        for x, places in offsets.items():
            found[x].append((len(places) * n, sequence, places))
        sequence += n
    out = {}
    for x, rows in found.items():
        size = np.array([len(p) for _, _, p in rows])
        out[x] = (
            np.cumsum([0] + [n for n, _, _ in rows[:-1]]), np.array([s for _, s, _ in rows]), size,
            np.cumsum(size) - size, np.array([o for _, _, p in rows for o in p]),
        )
    return out


def place(found: tuple[np.ndarray, ...], k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the k-th pieces of one length."""
    first, sequence, size, at, offsets = found
    e = np.searchsorted(first, k, side="right") - 1
    copy, which = np.divmod(k - first[e], size[e])
    return sequence[e] + copy, offsets[at[e] + which]


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of all documents, with the task that made each and how many of its length the task made before."""

    def make():
        encode, task, before = byte_level(path), TaskContext.get().partitionId(), Counter()

        def run(part):
            rows = []
            for d, ids in zip(part.column(0).to_pylist(), batch_ids(encode, part.column(1), end), strict=True):
                starts = [0] if len(ids) <= capacity else sorted(range(len(ids) - capacity, -1, -capacity))
                if starts[0]:
                    starts = [0, *starts]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((d, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), task, before[z - a]))
                    before[z - a] += 1
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 7

        return run

    return map_texts(docs.select("doc_id", "text"), f"{PIECES}, task int, nth long", make, **ROWS)


def packed(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """PIECES with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its rank within the task that
    made it plus the pieces of that length of all tasks before; only these
    counts, never the pieces, are brought into one order.
    """
    rows = saved(pieces(docs, path, end, capacity), "pieces")
    counts = saved(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most ``capacity`` rows
    given = slots(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "first")
    # as many counts as tasks have lengths: too many to broadcast as the corpus grows
    ranked = rows.join(firsts.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("k"))
    broadcast = docs.sparkSession.sparkContext.broadcast(given)

    def make():
        known = broadcast.value

        def run(part):
            length, k = part.column(3).to_numpy(), part.column(5).to_numpy()
            sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for x in np.unique(length).tolist():
                at = length == x
                sequence[at], offset[at] = place(known[x], k[at])
            return [*(part.column(i) for i in range(5)), sequence, offset]

        return run

    return map_texts(ranked, f"{PIECES}, sequence_id long, offset long", make)


def op5_best_fit_packing(spark, sf_dir):
    """The pieces of every whole text of ``documents`` with their places."""
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
