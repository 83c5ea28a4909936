import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrylog.llm import jaccard_join, language_id, line_dedup, neighbours, pii, quality
from quarrylog.llm.components import components


def test_quality(docs, nothing):
    rows = {r.doc_id: r for r in quality.judged(quality.ledger(docs)).collect()}
    for d in docs.collect():
        r, text = rows[d.doc_id], d.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    kept = sorted(str(r.doc_id) for r in quality.judged(quality.ledger(docs)).where("kept").collect())
    assert kept == sorted(str(r.doc_id) for r in quality.filtered(docs).collect())
    assert quality.filtered(nothing).count() == 0 and quality.filtered(docs).columns == docs.columns


def test_ablations(docs):
    rows = quality.judged(quality.ledger(docs))
    bits = [r.failed_bits for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        bit = next(1 << b for b, (name, _) in quality.RULES.items() if name == r.rule)
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_line_dedup(docs, nothing):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    rows = docs.collect()
    holders = {}
    for d in rows:
        if d.doc_id is not None:
            for line in (d.text or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(d.doc_id)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for d in rows:
        lines = (d.text or "").split("\n")
        lost = lambda x, d=d: d.doc_id is not None and len(holders.get(key(x), ())) > 1 and d.doc_id > min(holders[key(x)])
        stay = [x for x in lines if not lost(x)]
        assert (got[d.doc_id].text, got[d.doc_id].n_lines, got[d.doc_id].n_dropped) == ("\n".join(stay), len(lines), len(lines) - len(stay))
    assert line_dedup.line_dedup(nothing).count() == 0


@pytest.mark.parametrize("block", [400_000, 500])
def test_jaccard_join(docs, nothing, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [d for d in docs.collect() if d.doc_id is not None]
    sets = {}
    for d in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode().lower())
        sets[d.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect()}
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    # the row without an id is a copy of document 4
    assert got[None] == (len(sets[4]), find(4))
    if block == 400_000:
        assert jaccard_join.joined(nothing).count() == 0
        kept = {r.doc_id for r in jaccard_join.representatives(docs).collect()}
        assert kept == {i for i in ids if find(i) == i} | {None}


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def test_large_block_is_joined_by_parts_and_not_copied_for_each_pivot(spark, monkeypatch):
    rnd = random.Random(5)
    base, rows, want = rnd.sample(range(1 << 60), 400), [], {}
    for g in range(4):
        # at distances of 0.4 to 0.5 from another group's sets, and linked in each
        core = base[:300] + [(g + 1 << 60) + i for i in range(100)]
        for i in range(60):
            x = np.sort(np.array(core[:-2] + [(5 << 60) + 1000 * g + i], np.uint64))
            rows.append((1, bytearray(jaccard_join.class_of(x)), bytearray(x.tobytes())))
            want[bytes(rows[-1][1])] = g
    tiled, copies = jaccard_join.tiled, []

    def counted(known, regions):
        copies.append((known.join(regions.select("block"), "block", "left_semi").count(), regions.select("block").count()))
        return tiled(known, regions)

    monkeypatch.setattr(jaccard_join, "BLOCK", 10_000)
    monkeypatch.setattr(jaccard_join, "tiled", counted)
    links = jaccard_join.large_blocks(spark.createDataFrame(rows, "block long, cls binary, shingles binary"))
    root = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
    assert len(root) == len(rows) and all((root[a] == root[b]) == (want[a] == want[b]) for a in want for b in want)
    assert all(n <= len(rows) for n, _ in copies)


def test_join_block_is_exact_and_divides():
    rnd, tally = random.Random(3), Counter()
    for kinds in (1, 4, 12):
        for edits in (0.02, 0.12, 0.3):
            base = [rnd.sample(range(100000), 80) for _ in range(kinds)]
            sets = [np.unique(np.array([x if rnd.random() > edits else rnd.randrange(100000) for x in rnd.choice(base)], np.uint64)) for _ in range(60)]
            forest = jaccard_join.Forest(len(sets))
            for i in range(len(sets)):
                for j in range(i):
                    if linked(sets[i], sets[j]):
                        forest.join(i, j)
            assert jaccard_join.join_block(sets, tally) == [forest.root(i) for i in range(len(sets))]
    assert tally["divisions"] >= 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return True


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    parts = ["a", "b.", "@", "x.com", ".", "1", "12", "255", "256", "007", " ", "-", "+1", "(555)", "4111 1111 1111 1111", "\n", "é", "%", "378282246310005", "@@", "a@b.c", "１"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]
        assert pii.base_spans(text) == want


def test_disclosing_terms(spark, nothing):
    rows = [(i, f"word{'abcdefgh'[i]} common secretname mail jo@x.org now common other{'hgfedcba'[i]}") for i in range(4)]
    rows += [(1000 + i, "common words now and nothing else mail") for i in range(100)] + [(50, "the secretname, alone"), (51, None), (52, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detected(docs).collect()}
    assert all([s.kind for s in found[i].base] == ["email"] for i in range(4))
    term = found[50].added
    assert [(s.kind, rows[-3][1][s.start : s.end]) for s in term] == [("term", "secretname")]
    assert not found[1000].added and not found[51].base
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[50] == "the [term], alone" and clean[0] == "worda common [term] mail [email] now common otherh" and clean[51] is None
    assert pii.detected(nothing).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {r.base_sha256 for r in digest(docs)}


def test_one_document_discloses(spark):
    rows = [(0, "ask Zebulon o'hanrahan jo@x.org about words"), (1, "and then nothing")] + [(i, "ask about words and nothing else") for i in range(2, 100)]
    found = {r.doc_id: r for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[0][1][s.start : s.end] for s in found[0].added] == ["Zebulon", "o'hanrahan"]
    assert not any(found[i].added for i in range(1, 100))


def digest(docs):
    import unittest.mock

    with unittest.mock.patch.object(pii, "documents", lambda *_: docs):
        return pii.op6_pii(None, "").collect()


def test_language_id(spark, docs, nothing):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rnd = random.Random(1)
    words = {"en": "the of and with that from this have".split(), "fr": "les des avec pour dans une est que".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(40)), x if i % 5 else None) for i in range(80) for x in [("en", "fr")[i % 2]]]
    rows += [(100, None, "en"), (101, "12 34", "fr"), (102, "", None), (None, "the of and", "en")]
    got = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()}
    import zlib

    for i, _, _ in rows[:80]:
        assert got[i].lang_pred == ("en", "fr")[i % 2] and 0.5 < got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and not got[None].held_out
    assert language_id.identified(nothing, path).count() == 0


def test_forward_sums_all_segmentations():
    chances = {"▁": [0.1], "▁a": [0.2], "a": [0.3], "b": [0.15], "ab": [0.25]}
    scorer = language_id.Scorer(["x"], chances)
    want = 0.2 * 0.15 + 0.1 * 0.3 * 0.15 + 0.1 * 0.25
    assert np.isclose(np.exp(scorer.forward("▁ab")[0]), want) and np.isclose(np.exp(scorer.forwards(["▁ab", "▁a"])[0, 0]), want)


def test_neighbours(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 20)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (700, [0.0] * 20), (800, [float("nan")] * 20), (900, [1.0, None] + [0.0] * 18), (1000, [1.0]), (None, [1.0] * 20)]
    got = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 600, 50))
    hits = 0
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(axis=1))
    for q, own in got.items():
        s = (y[q] * y).sum(axis=1) / (norm[q] * norm)
        s[q] = -2
        want = np.lexsort((np.arange(600), -s))[:5].tolist()
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hits += len(set(want) & {r.vec_id for r in own})
        if q == 100:
            assert [r.vec_id for r in own] == want
    assert hits >= 0.9 * 60
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.neighbours(few, "vec_id % 50 = 0").collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.neighbours(few.limit(0), "vec_id % 50 = 0").count() == 0


def test_neighbours_that_tie_and_overflow(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 8))
    x[1:41] = x[0] * 2.0 ** np.arange(-20, 20)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, [1e200, 1e200]), (1001, [1e-200, 1e-200]), (1002, [1e200, -1e200]), (1003, [5e-324, 0.0]), (1050, [3.0, 4.0])]
    rows += [(2000 + i, np.eye(30)[i].tolist()) for i in range(30)]
    got = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[1000]] == [1001, 1050, 1003, 1002] and got[1000][0][1] == pytest.approx(1) and [i for i, _ in got[1050]][:2] == [1000, 1001]
    # all others tie
    assert got[2000] == [(2001 + i, 0.0) for i in range(5)]


def test_buckets_grow_with_the_table():
    rnd = np.random.default_rng(4)
    x = neighbours.unit(rnd.normal(size=(2000, 16)))
    for n in (10, 20_000, 2_000_000):
        tables = neighbours.Tables(16, n)
        assert n / 512 <= tables.buckets <= max(4, n / 64)
        key, order = tables.bucket(x, 1), tables.order(x, 1, 50)
        assert (order[:, 0] == key).all() and key.max() < tables.buckets
        assert all(len(set(row)) == len(row) for row in order.tolist())
