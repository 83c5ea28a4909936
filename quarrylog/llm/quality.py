"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; policies are versioned masks over those bits, so a
new policy, or the effect of leaving a rule out, needs no second look at texts.

Defined results: a null or empty text has no words, so it fails ``few_words``
and is not kept; a null doc_id passes through; repeated rows are judged each by
itself; a measure that equals a rule's bound passes; extra columns are ignored
(``filtered`` keeps them), whatever their names; an empty table gives an empty
ledger; a very long text is measured whole.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import ddl_of, documents, quoted, unused

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

#: Bit -> (name, SQL condition of failure over the measurements).  Bits are never reused.
RULES = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    2: ("short_words", "word_chars < 2 * n_words"),
    3: ("long_words", "word_chars > 25 * n_words"),
    4: ("symbols", "n_symbols > n_words"),
    5: ("repeated_lines", "2 * n_dup_lines > n_lines"),
}
BASE_MASK = 0b11
#: Version -> mask of the rules whose failure rejects a document.
POLICIES = {"base": BASE_MASK, "v1": 0b111111}
DEFAULT_POLICY = "v1"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def _measure():
    def measure(part):
        ids, texts = part.column(0), part.column(1)
        chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        out = [[] for _ in range(6)]
        for n, b in zip(chars, texts.cast("binary").to_pylist(), strict=True):
            b = b or b""
            words = b.split()
            lines = [x for x in b.split(b"\n") if x.strip()]
            row = (len(words), n - len(b) + len(b.translate(None, SPACES)), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))
            for column, x in zip(out, row, strict=True):
                column.append(x)
        return [ids, *out]

    return measure


def failures(measures: str = "") -> str:
    """SQL for the failure bits, from measurements that are columns, or fields of the column ``measures``."""
    read = lambda test: re.sub(r"\b[a-z]\w+\b", lambda m: f"{measures}.{m[0]}", test) if measures else test
    return " + ".join(f"CASE WHEN {read(test)} THEN {1 << bit}L ELSE 0L END" for bit, (_, test) in RULES.items())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and ``failed_bits``: bit i is set when rule i fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_texts(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), f"doc_id {kind}, {MEASURES}", _measure)
    return rows.withColumn("failed_bits", F.expr(failures()))


def judged(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``; base failures are never kept."""
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.withColumns({"base_failed": base, "kept": F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE_MASK)) == 0})


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if the rule were left out.

    Documents are first counted by mask, so only as many rows as there are
    different masks (at most 2 ** rules) meet the rules, every mask with every rule.
    """
    mask = POLICIES[policy] | BASE_MASK
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = rows.sparkSession.createDataFrame([(name, 1 << bit) for bit, (name, _) in RULES.items() if mask >> bit & 1], "rule string, bit long")
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    others = F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit")))
    return masks.join(F.broadcast(rules)).groupBy("rule").agg(
        F.sum(F.when(fails != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((fails != 0) & (others == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filtered(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were; the ledger's rules are applied to a column of measurements beside them."""
    names = docs.columns
    at, own = names.index(text_col), unused("measures", names)

    def make():
        measure = _measure()

        def run(part):
            _, *columns = measure(part.select([at, at]))
            fields = [pa.array(c, pa.int64()) for c in columns]
            return [*part.columns, pa.StructArray.from_arrays(fields, names=[x.split()[0] for x in MEASURES.split(", ")])]

        return run

    rows = map_texts(docs, f"{ddl_of(docs.schema)}, {own} struct<{MEASURES.replace(' long', ': bigint')}>", make, at)
    return rows.where(F.expr(failures(own)).bitwiseAND(F.lit(POLICIES[policy] | BASE_MASK)) == 0).select(*map(quoted, names))


def op8_quality_rules(spark, sf_dir):
    """doc_id, measurements, failed_bits, base_failed and kept of every whole text of ``documents``."""
    return judged(ledger(documents(spark, sf_dir)))


def quality_ablations(spark, sf_dir):
    """Per rule of the default policy: documents failing it, failing it alone, and kept if it were left out."""
    return ablations(ledger(documents(spark, sf_dir)))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT *, [struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) for i in range(1, len(w) - 1)] AS g FROM w),
r AS (SELECT doc_id, p.i AS i FROM (SELECT doc_id, unnest([{'i': i, 'g': g[i]} for i in range(1, len(g) + 1)]) AS p FROM g)
      QUALIFY count(*) OVER (PARTITION BY doc_id, p.g) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) AS s(k) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM g LEFT JOIN n USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
      + CASE WHEN n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines::BIGINT AS n_lines, failed_bits,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

ABLATIONS_SQL = f"""
WITH q AS ({SQL.strip()}),
r AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {1 << bit})" for bit, (name, _) in RULES.items() if (POLICIES[DEFAULT_POLICY] | BASE_MASK) >> bit & 1)}) AS v(rule, bit))
SELECT rule, sum(CASE WHEN failed_bits & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed,
       sum(CASE WHEN failed_bits = bit THEN 1 ELSE 0 END)::BIGINT AS n_failed_alone,
       sum(CASE WHEN failed_bits & ~bit = 0 THEN 1 ELSE 0 END)::BIGINT AS n_kept_without
FROM q, r GROUP BY rule
"""
