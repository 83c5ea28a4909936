"""Personal data: fixed patterns, then information-theoretic sanitisation.

Patterns find the entities to protect (base spans).  Terms near them may tell
who is meant even when the entity itself is masked.  How much a term t tells
about an entity e is their pointwise mutual information against the entity's
information content: PMI(t, e) / IC(e) = 1 + log2 P(e | t) / IC(e), with
P(e | t) from counts over all documents, in which every term has SMOOTHING more
documents without the entity, so few documents weigh less but are not left out.
A term is disclosing when that ratio and P(e | t) itself reach the thresholds.
Disclosing terms are spans wherever they stand; sanitised texts name an entity's
or term's kind instead.

A term is a word without its edge marks, in lower case, that has a letter or a
digit; it is seen with an entity if it is one of the WINDOW words on either side
within the line.

Defined results: a null or empty text has no spans; a null doc_id passes
through; repeated rows are counted each and treated alike; a ratio or chance
that equals its threshold discloses; terms that tie all disclose; spans at one
place come by kind, then end; an empty table gives an empty result; extra
columns are ignored (``sanitised`` keeps them), whatever their names; a very
long text is read whole, in time that grows with its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .arrow import map_texts
from .common import ddl_of, documents, lookup, quoted, saved, unused

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails at the first digit of a run fails at its others too.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Words on either side of an entity, within its line, that are its surroundings.
WINDOW = 8
SMOOTHING, MIN_RATIO, MIN_CHANCE = 0.5, 0.9, 0.5
#: Terms are looked for through a bitmap of this many bits, two for each term, whatever their number.
BITS = 1 << 24
EDGES = "\"'()[]{}<>.,;:!?…»«"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and domain; from each @ the local part is the run before it, back to the last match at most."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def term_of(word: str) -> str | None:
    """A word in lower case without edges; None if no letter or digit is left."""
    term = word.strip(EDGES).lower()
    return term if term.isalnum() or any(map(str.isalnum, term)) else None


class Surroundings:
    """The words of a text by place, to find those around a span."""

    def __init__(self, text: str):
        places = [m.span() for m in re.finditer(r"\S+", text)]
        self.text, self.starts, self.ends = text, [a for a, _ in places], [b for _, b in places]

    def __call__(self, start: int, end: int) -> list[str]:
        """The terms around a span, nearest WINDOW words on each side within the line; words that the span cuts are none."""
        text, out = self.text, []
        k = bisect_right(self.ends, start) - 1
        if k >= 0 and self.ends[k] == start:
            k -= 1
        right = start
        for i in range(k, max(-1, k - WINDOW), -1):
            if text.find("\n", self.ends[i], right) >= 0:
                break
            out.append(text[self.starts[i] : self.ends[i]])
            right = self.starts[i]
        k, left = bisect_left(self.starts, end), end
        if k < len(self.starts) and self.starts[k] == end:
            k += 1
        for i in range(k, min(len(self.starts), k + WINDOW)):
            if text.find("\n", left, self.starts[i]) >= 0:
                break
            out.append(text[self.starts[i] : self.ends[i]])
            left = self.ends[i]
        return [t for w in out if (t := term_of(w))]


def entity_of(kind: str, value: str) -> str:
    """The same entity however it is written."""
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or kind == 'ip' and c == '.')}"


def row_key(doc_id, raw: bytes) -> bytes:
    """One key for a row, equal for equal rows."""
    return xxh3_128_digest(raw, seed=xxh3_64_intdigest(str(doc_id)))


BASE = "row_key binary, doc_id long, spans array<struct<kind: string, start: int, end: int>>"


def scanned(docs: DataFrame) -> DataFrame:
    """BASE of every row, then ``seen``: what surrounds each different entity, as (entity, terms)."""

    def make():
        def run(part):
            keys, spans, seen = [], [], []
            for d, raw in zip(part.column(0).to_pylist(), part.column(1).cast("binary").to_pylist(), strict=True):
                text = (raw or b"").decode()
                found = base_spans(text)
                keys.append(row_key(d, raw or b""))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                near: dict[str, set[str]] = {}
                around = Surroundings(text) if found else None
                for k, a, b in found:
                    near.setdefault(entity_of(k, text[a:b]), set()).update(around(a, b))
                seen.append([{"entity": e, "terms": sorted(terms)} for e, terms in near.items()])
            return [keys, part.column(0), spans, seen]

        return run

    return map_texts(docs.select("doc_id", "text"), f"{BASE}, seen array<struct<entity: string, terms: array<string>>>", make)


def bits_of(term: str) -> tuple[int, int]:
    h = xxh3_64_intdigest(term)
    return h % BITS, (h >> 32) % BITS


def bitmap(terms: DataFrame) -> np.ndarray | None:
    """The terms' bits as bytes; None if there is no term.  At most BITS / 64 words come to the driver."""

    def make():
        return lambda part: [[b for x in part.column(0).to_pylist() for b in bits_of(x)]]

    bits = map_texts(terms.select("term"), "b int", make, 0)
    words = bits.groupBy(F.expr("cast(b div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("bits")).toArrow()
    if not words.num_rows:
        return None
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


class Finder:
    """Words of a text whose terms have their bits set."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.known = bits, {}

    def __call__(self, word: str) -> str | None:
        try:
            return self.known[word]
        except KeyError:
            pass
        term = term_of(word)
        if term is not None and not all(self.bits[b >> 3] >> (b & 7) & 1 for b in bits_of(term)):
            term = None
        if len(self.known) > 400_000:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = term
        return term


def document_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """term and the number of documents that hold it; terms without their bits are left out, and a task sends a term once."""
    given = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        find, counts = Finder(given.value), {}

        def run(part):
            for text in part.column(0).to_pylist():
                for term in {find(w) for w in set((text or "").split())} - {None}:
                    counts[term] = counts.get(term, 0) + 1
            if len(counts) > 200_000:
                return rest()
            return [[], []]

        def rest():
            out = [list(counts), list(counts.values())]
            counts.clear()
            return out

        run.rest = rest
        return run

    return map_texts(docs.select("text"), "term string, n long", make, 0).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, base: DataFrame, n_docs: int) -> DataFrame | None:
    """The terms that disclose an entity; None if no term is near any entity."""
    seen = base.select(F.explode("seen").alias("s")).select("s.*")
    # a row has an entity once and a term once with it, so counts are of rows, and are pre-aggregated
    both = seen.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    candidates = saved(both, "candidate-terms")
    bits = bitmap(candidates.select("term").distinct())
    if bits is None:
        return None
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    rows = lookup(lookup(candidates, saved(document_counts(docs, bits), "term-counts"), "term"), saved(entities, "entity-counts"), "entity")
    chance = F.col("n_both") / (F.col("n_term") + SMOOTHING)
    ratio = 1 + F.log2(chance) / F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    return saved(rows.where((chance >= MIN_CHANCE) & (F.col("n_entity") < n_docs) & (ratio >= MIN_RATIO)).select("term").distinct(), "disclosing-terms")


def term_spans(docs: DataFrame, terms: DataFrame | None) -> DataFrame | None:
    """row_key and the ``added`` spans of disclosing terms; rows without any are left out."""
    bits = bitmap(terms) if terms is not None else None
    if bits is None:
        return None
    given = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        find = Finder(given.value)

        def run(part):
            out = [[], [], []]
            for d, raw in zip(part.column(0).to_pylist(), part.column(1).cast("binary").to_pylist(), strict=True):
                text = (raw or b"").decode()
                hits = {w: t for w in set(text.split()) if (t := find(w))}
                if not hits:
                    continue
                base = sorted((a, b) for _, a, b in base_spans(text))
                starts, places = [a for a, _ in base], {}
                for m in re.finditer("|".join(map(re.escape, sorted(hits, key=len, reverse=True))), text):
                    a, b = m.span()
                    if (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()):
                        word = m[0]
                        a += len(word) - len(word.lstrip(EDGES))
                        b -= len(word) - len(word.rstrip(EDGES))
                        k = bisect_left(starts, b)
                        if not any(z > a for _, z in base[max(0, k - 4) : k]):
                            places.setdefault(hits[word], []).append({"kind": "term", "start": a, "end": b})
                key = row_key(d, raw)
                for term, found in places.items():
                    for column, x in zip(out, (key, term, found), strict=True):
                        column.append(x)
            return out

        return run

    hits = map_texts(docs.select("doc_id", "text"), "row_key binary, term string, found array<struct<kind: string, start: int, end: int>>", make)
    # the bitmap lets other terms through now and then; the table doesn't
    sure = lookup(saved(hits, "term-hits"), terms, "term").distinct()
    return sure.groupBy("row_key").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("added"))


def detected(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, ``base`` spans and ``added`` spans of every row."""
    base = saved(scanned(docs), "base-spans")
    added = term_spans(docs, disclosing(docs, base, base.count()))
    rows = base.select("row_key", "doc_id", F.col("spans").alias("base"))
    if added is None:
        return rows.withColumn("added", F.array().cast("array<struct<kind: string, start: int, end: int>>"))
    return rows.join(saved(added, "added-spans"), "row_key", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind: string, start: int, end: int>>")))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with spans replaced by their kinds; spans that overlap become one, of the first's kind."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the text masked."""
    found = detected(docs)
    names, at, ident = docs.columns, docs.columns.index("text"), docs.columns.index("doc_id")
    key, more = unused("row_key", names), unused("added", names)
    added = found.where("size(added) > 0").select(F.col("row_key").alias(key), F.col("added").alias(more)).dropDuplicates([key])
    ddl = ddl_of(docs.schema)

    def keyed():
        return lambda part: [*part.columns, [row_key(d, raw or b"") for d, raw in zip(part.column(ident).to_pylist(), part.column(at).cast("binary").to_pylist(), strict=True)]]

    rows = map_texts(docs, f"{ddl}, {key} binary", keyed, at).join(added, key, "left").select(*map(quoted, names), more)

    def mask():
        def run(part):
            texts = []
            for text, extra in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                spans = base_spans(text or "") + [(x["kind"], x["start"], x["end"]) for x in extra or []]
                texts.append(masked(text, spans) if spans else text)
            return [texts if i == at else part.column(i) for i in range(len(names))]

        return run

    return map_texts(rows, ddl, mask, at)


def op6_pii(spark, sf_dir):
    """doc_id, counts by kind, base_sha256 and all spans of every whole text of ``documents``."""
    found = detected(documents(spark, sf_dir).select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)") for k in KINDS}
    return found.select(
        "doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(written("base"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
