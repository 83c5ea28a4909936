"""Language identification by segmentation-marginalised unigrams.

A word is emitted piece by piece from a fixed public vocabulary; its
probability in a language sums over all ways to segment it, by the forward
algorithm.  Piece probabilities come from expectation maximisation over all
words of a bounded sample of labelled texts: at most TRAIN_DOCS documents a
language, in the order of a hash of their id.  Every text is scored whole.

Defined results: ``und`` with score 0 if a text is null or has no letters, or
if nothing was learned; a null doc_id is neither held out nor learned from;
repeated rows are scored each, and learned from once for each if their doc_id is
in the sample; ties go to the language that sorts first; an empty table gives an
empty result; extra columns are ignored, whatever their names; a very long text
is scored whole, run of letters by run.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import documents, saved

TRAIN_DOCS, ROUNDS = 100, 3
#: Runs of letters that a worker keeps.
MEMO_CHUNKS = 150_000
#: A letter that no piece begins with costs FLOOR in every language.
FLOOR = 1e-7
#: Longer runs of letters are scored one at a time; HASH makes one number of a piece's characters.
BATCH_CHARS, HASH = 40, np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")


@cache
def vocabulary(path: str) -> frozenset[str]:
    """Pieces of letters, those that begin a word with U+2581 before them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return frozenset(p for p in pieces if p.removeprefix("▁").isalpha() and p == p.lower())


def letter_runs(text: str) -> list[str]:
    """Runs of letters; the pattern lets numbers like ½ pass, which are none."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]


def longest(pieces) -> int:
    return max(map(len, pieces), default=1)


def expected(words: dict[str, int], chance: dict[str, float]) -> Counter:
    """How often each piece is expected in the words, over all segmentations."""
    out, most = Counter(), longest(chance)
    for word, times in words.items():
        n = len(word)
        ways = [(i, j, p, chance[p]) for i in range(n) for j in range(i + 1, min(n, i + most) + 1) if (p := word[i:j]) in chance]
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, _, c in ways:
            forward[j] += forward[i] * c
        for i, j, _, c in reversed(ways):
            backward[i] += c * backward[j]
        if forward[n] > 0:
            for i, j, p, c in ways:
                out[p] += times * forward[i] * c * backward[j] / forward[n]
    return out


def fit(words: dict[str, dict[str, int]], pieces: frozenset[str], rounds: int = ROUNDS) -> tuple[list[str], dict[str, list[float]]]:
    """Languages in order, and each piece's probability in each of them."""
    languages, most = sorted(words), longest(pieces)
    chances = {}
    for language in languages:
        seen = {p for w in words[language] for i in range(len(w)) for j in range(i + 1, min(len(w), i + most) + 1) if (p := w[i:j]) in pieces}
        chance = dict.fromkeys(seen, 1 / max(1, len(seen)))
        for _ in range(rounds):
            counts = expected(words[language], chance)
            total = sum(counts.values())
            chance = {p: n / total for p, n in counts.items() if n > 1e-6}
        chances[language] = chance
    known = {p for c in chances.values() for p in c}
    return languages, {p: [max(chances[x].get(p, 0.0), FLOOR) for x in languages] for p in known}


class Scorer:
    """Log-likelihoods of texts by language; runs of letters are kept with theirs."""

    def __init__(self, languages: list[str], chances: dict[str, list[float]]):
        self.languages, self.chances = languages, chances
        pieces, self.most = sorted(chances), longest(chances)
        self.chance = np.array([chances[p] for p in pieces] + [[FLOOR] * len(languages)])
        # by length: the pieces' hashes in order, and their rows in ``chance``
        self.table = []
        for size in range(1, self.most + 1):
            rows = np.array([k for k, p in enumerate(pieces) if len(p) == size], np.int64)
            codes = np.array([[ord(c) for c in pieces[k]] for k in rows.tolist()], np.uint64).reshape(len(rows), size)
            hashes = np.zeros(len(rows), np.uint64)
            for k in range(size):
                hashes = hashes * HASH + codes[:, k]
            order = np.argsort(hashes)
            self.table.append((hashes[order], rows[order]))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.languages)))

    def forward(self, run: str) -> list[float]:
        """Log-probability of one run of letters in each language, over all its segmentations."""
        chances, n, size = self.chances, len(run), len(self.languages)
        at, shift = [[0.0] * size for _ in range(n + 1)], [0.0] * size
        at[0] = [1.0] * size
        for i in range(n):
            for k in range(size):
                if 0 < at[i][k] < 1e-100:  # a long run: carry the scale apart
                    top = at[i][k]
                    for j in range(i, min(n, i + self.most) + 1):
                        at[j][k] /= top
                    shift[k] += math.log(top)
            for j in range(i + 1, min(n, i + self.most) + 1):
                chance = chances.get(run[i:j]) or (j == i + 1 and [FLOOR] * size)
                if chance:
                    at[j] = [t + a * c for t, a, c in zip(at[j], at[i], chance, strict=True)]
        return [math.log(x) + s for x, s in zip(at[n], shift, strict=True)]

    def forwards(self, words: list[str]) -> np.ndarray:
        """``forward`` of many runs of at most BATCH_CHARS letters, position by position."""
        sizes = np.array(list(map(len, words)))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = np.frombuffer("".join(words[k] for k in order.tolist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(codes))  # letters from here to the run's end
        found, hashes, place = [], np.zeros(len(codes), np.uint64), np.arange(len(codes))
        for size in range(1, min(self.most, int(sizes[0])) + 1):
            # only where a piece of this size ends within the run
            stay = left[place] >= size
            place, hashes = place[stay], hashes[stay] * HASH + codes[place[stay] + size - 1]
            known, rows = self.table[size - 1]
            at = np.full(len(codes), len(self.chance) - 1 if size == 1 else -1)
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[k] == hashes
                at[place[hit]] = rows[k[hit]]
            found.append(at)
        longest = int(sizes[0])
        alpha = np.zeros((longest + 1 + self.most, len(words), len(self.languages)))
        alpha[0] = 1.0
        for i in range(longest):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # runs with a letter here come first
            for size in range(1, min(self.most, longest - i) + 1):
                at = found[size - 1][first[:n] + i]
                sel = np.flatnonzero(at >= 0)
                if len(sel):
                    alpha[i + size, sel] += alpha[i, sel] * self.chance[at[sel]]
        out = np.empty((len(words), len(self.languages)))
        out[order] = np.log(alpha[sizes, np.arange(len(words))])
        return out

    def learn(self, words: list[str]) -> None:
        """Keep the rows of new runs."""
        short = [w for w in words if len(w) < BATCH_CHARS]
        long = [w for w in words if len(w) >= BATCH_CHARS]
        made = [self.forwards(["▁" + w for w in short])] if short else []
        made += [np.array([self.forward("▁" + w) for w in long])] if long else []
        n = len(self.numbers)
        while n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.numbers.update(zip([*short, *long], range(n, n + len(words)), strict=True))
        self.rows[n : n + len(words)] = np.concatenate(made)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.numbers) > MEMO_CHUNKS:
            self.forget()
        split = [letter_runs(x) if x else [] for x in texts]
        if new := list(set().union(*split) - self.numbers.keys()):
            self.learn(new)
        out, number = [], self.numbers.__getitem__
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            scores = self.rows[np.fromiter(map(number, words), np.int64, len(words))].sum(axis=0).tolist()
            best = max(range(len(scores)), key=lambda k: scores[k])
            out.append((self.languages[best], 1.0 / sum(math.exp(max(x - scores[best], -700.0)) for x in scores)))
        return out


def training_words(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, dict[str, int]]:
    """language -> word -> count, of the bounded sample; ``docs`` has doc_id, text and lang, rows to learn from only."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    ids = docs.select("doc_id", "lang", order.alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    # the first of each part of a language, then the first of all parts': no language is brought into one task whole
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).where(f"n <= {train_docs}")
    chosen = saved(first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(f"n <= {train_docs}").select("doc_id").distinct(), "language-sample")

    def make():
        def count(part):
            counts: dict[tuple, int] = defaultdict(int)
            for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for run, n in Counter(letter_runs(text or "")).items():
                    counts[language, "▁" + run] += n
            return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

        return count

    # the sample's ids are at most TRAIN_DOCS a language
    sample = docs.join(F.broadcast(chosen), "doc_id").select("lang", "text")
    words = map_texts(sample, "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for row in words.orderBy("lang", "word").collect():  # the words of TRAIN_DOCS documents a language
        out[row.lang][row.word] = row.n
    return out


def identified(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows that aren't held out and have a lang."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False)))
    words = training_words(rows.where("not held_out and doc_id is not null and lang is not null and text is not null").select("doc_id", "text", "lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(words, vocabulary(path)))

    def make():
        scorer = Scorer(*model.value)

        def run(part):
            found = scorer.predict(part.column(1).to_pylist())
            return [part.column(0), part.column(2), [x for x, _ in found], [x for _, x in found]]

        return run

    return map_texts(rows.select("doc_id", "text", "held_out"), "doc_id long, held_out boolean, lang_pred string, score double", make)


def op1_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred and score of every whole text of ``documents``."""
    import public_tokenizers

    return identified(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
