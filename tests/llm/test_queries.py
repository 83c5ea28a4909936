"""The registered queries over a table with nulls, empties, repeated rows and clashing names, against brute force."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarrylog.llm import byte_bpe, language_id, pii, queries

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    rnd = np.random.default_rng(0)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(rnd.normal(size=(120, 6)).astype(np.float32))] + [(150, None, "y"), (200, [0.0] * 6, "y"), (250, [1.0, None], "y")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def table(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def rows_of(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).collect()
    if name not in ("op5_best_fit_packing", "op9_neighbours"):
        assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return found


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, sf_dir):
    for r in rows_of(spark, sf_dir, "op1_language_id"):
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1


def test_op1_on_held_out_documents(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no sample tables")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{at}/documents.parquet").where("lang is not null and text rlike '[a-z]{3}'").collect()}
    held = [r for r in queries.QUERIES["op1_language_id"](spark, at).collect() if r.held_out and r.doc_id in langs]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def test_numbers_are_no_letters():
    assert language_id.letter_runs("½ ② ² ௧ 12 _") == [] and language_id.letter_runs("Été½x日本") == ["été", "x日本"]
    scorer = language_id.Scorer(["x"], {"▁a": [0.5]})
    assert [x for x, _ in scorer.predict(["½ ②", "a", None])] == ["und", "x", "und"]


def test_forward_is_the_sum_over_segmentations():
    rnd = np.random.default_rng(2)
    word = "▁abcabacb"
    pieces = {word[i:j]: rnd.random(2).tolist() for i in range(len(word)) for j in range(i + 1, len(word) + 1) if j == i + 1 or rnd.random() < 0.5}

    def total(at):
        return np.ones(2) if at == len(word) else sum((np.array(pieces[word[at:j]]) * total(j) for j in range(at + 1, len(word) + 1) if word[at:j] in pieces), np.zeros(2))

    scorer = language_id.Scorer(["x", "y"], pieces)
    assert np.allclose(np.exp(scorer.forwards([word, "▁a"])[0]), total(0)) and np.allclose(np.exp(scorer.forward(word)), total(0))


def test_op2(spark, sf_dir, table):
    holders = {}
    key = lambda x: x.strip(STRIP).translate(LOWER)
    for d, t in table:
        for line in (t or "").split("\n") if d is not None else []:
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    want = Counter()
    for d, t in table:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(holders.get(key(x), ())) < 2 or d == min(holders[key(x)])]
        want[d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows_of(spark, sf_dir, "op2_line_dedup")) == want


def test_op3(spark, sf_dir, table):
    library, texts, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), dict(table), 0
    for r in sorted(rows_of(spark, sf_dir, "op3_token_file"), key=lambda r: r.start):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(little(ids)))
        at += len(ids)


def test_op4(spark, sf_dir, table):
    library, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), dict(table)
    for r in rows_of(spark, sf_dir, "op4_token_counts"):
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def test_op5(spark, sf_dir, table):
    library, places, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, Counter()
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in table}
    for r in rows_of(spark, sf_dir, "op5_best_fit_packing"):
        assert r.ids_crc32 == zlib.crc32(little(ids[r.doc_id][r.start : r.start + r.length])) and (r.length == 2048 or r.piece == 0)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == Counter([d for d, _ in table for _ in ids[d]])
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert len(places) == -(-sum(pieces.values()) // 2048)


def test_op6(spark, sf_dir, table):
    texts = dict(table)
    for r in rows_of(spark, sf_dir, "op6_pii"):
        spans = [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(spans)


def test_personal_data_in_long_texts_takes_linear_time():
    began = time.process_time()
    for text in ("7" * 1_000_000, "1.2." * 250_000, "a@" * 500_000, "+1" + " " * 1_000_000, "x" * 1_000_000 + "@b.c", "+1 " * 300_000):
        pii.base_spans(text)
    around = pii.Surroundings("a@b.cd " * 100_000)
    assert all(len(around(i * 7, i * 7 + 6)) >= 8 for i in range(0, 100_000, 100))
    assert time.process_time() - began < 30


def test_op6_terms_are_the_brute_force_ones(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 12)) + (f" ask {n}-{rng.integers(3)} at {n}@x.org please\nnext line" if (n := rng.choice(["kim", "lee", "zoe", ""], p=[0.1, 0.1, 0.05, 0.75])) else "") for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    every = [*texts, texts[0]]
    n_term, n_both, n_entity = Counter(), Counter(), Counter()
    for text in every:
        n_term.update({t for w in text.split() if (t := pii.term_of(w))})
        near = {}
        for k, a, b in pii.base_spans(text):
            line = text.rfind("\n", 0, a) + 1, (text + "\n").find("\n", b)
            near.setdefault(pii.entity_of(k, text[a:b]), set()).update(t for w in text[line[0] : a].split()[-8:] + text[b : line[1]].split()[:8] if (t := pii.term_of(w)))
        n_entity.update(near.keys())
        n_both.update((e, t) for e, terms in near.items() for t in terms)
    want = set()
    for (e, t), n in n_both.items():
        chance = n / (n_term[t] + 0.5)
        if chance >= 0.5 and 1 + np.log2(chance) / np.log2(len(every) / n_entity[e]) >= 0.9:
            want.add(t)
    base = pii.saved(pii.scanned(docs), "base")
    assert {r.term for r in pii.disclosing(docs, base, len(every)).collect()} == want and want


def test_op7(spark, sf_dir, table):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = dict(table)
    for r in rows_of(spark, sf_dir, "op7_byte_bpe"):
        ids, raw = own.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_op8(spark, sf_dir, table):
    texts = dict(table)
    for r in rows_of(spark, sf_dir, "op8_quality_rules"):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert r.n_words == len(words) and r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.kept and r.base_failed)
    assert {r.rule for r in queries.QUERIES["quality_ablations"](spark, sf_dir).collect()} == {"few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"}


def test_op9(spark, sf_dir):
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 120").collect()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows_of(spark, sf_dir, "op9_neighbours")}
    assert sorted(got) == [(q, k) for q in (0, 50, 100) for k in range(1, 6)]
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    assert all(abs(s - cosine(x[q], x[v])) < 1e-12 for (q, _), (v, s) in got.items())
    want = {(q, v) for q in (0, 50, 100) for v in sorted((i for i in x if i != q), key=lambda i: (-cosine(x[q], x[i]), i))[:5]}
    assert len(want & {(q, v) for (q, _), (v, _) in got.items()}) >= 0.9 * 15


def test_op10(spark, sf_dir, table):
    texts = dict(table)
    for r in rows_of(spark, sf_dir, "op10_jaccard_join"):
        words = re.findall(r"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").translate(LOWER))
        assert r.n_shingles == (len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else 0)
