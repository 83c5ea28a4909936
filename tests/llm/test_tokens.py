import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylog.llm import byte_bpe, chunks, library_tokens, packing, token_counts, token_file
from quarrylog.llm.common import saved, shared_dir

JSON, WORD, MULTI = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "1234", "...", " ", "\x1c", "\x85", "ing", "<|endoftext|>", "\r\n", "Ж", "J̌", "İ"]


def strange(n=800):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_libraries(texts):
    every = [t for t in texts if t is not None] + strange()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(MULTI), special_tokens={})
    byte, word = Tokenizer.from_file(JSON), Tokenizer.from_file(WORD)
    for encoder, want in (
        (library_tokens.byte_level(JSON), [ids_of(byte, t) for t in every]),
        (library_tokens.word_level(WORD), [ids_of(word, t) for t in every]),
        (byte_bpe.encoder(MULTI), [own.encode_ordinary(t) for t in every]),
    ):
        assert [x.tolist() for x in encoder.batch(pa.array(every))] == want
        assert [encoder(t).tolist() for t in every[:50]] == want[:50]
    for t in every:
        assert byte_bpe.decode(MULTI, byte_bpe.encode(MULTI, t)) == t.encode()


def test_memo_forgets_and_compares_bytes(monkeypatch):
    encoder = chunks.Encoded(library_tokens.Words(JSON, " ", False))
    encoder.memo.limit = 20_000
    library, every = Tokenizer.from_file(JSON), strange(300)
    for k in range(0, len(every), 20):
        assert [x.tolist() for x in encoder.batch(pa.array(every[k : k + 20]))] == [ids_of(library, t) for t in every[k : k + 20]]
    assert encoder.memo.size() < 60_000
    # all words have one hash
    monkeypatch.setattr(chunks.Memo, "hashed", staticmethod(lambda flat, ends: np.zeros(len(ends) - 1, np.uint64)))
    encoder = chunks.Encoded(library_tokens.Words(JSON, " ", False))
    for _ in range(2):
        assert [x.tolist() for x in encoder.batch(pa.array(every))] == [ids_of(library, t) for t in every]


def test_word_level_encodes_each_lower_case_piece_once():
    encoder, library = library_tokens.word_level.__wrapped__(WORD), Tokenizer.from_file(WORD)
    every = ["Word word. WORD,\nword: (word) word!! Été été.", "Word's 'tis WE'RE x'll ,'s 1's it's. ''word", "  \n word  \n\n", "", "a<|endoftext|>b <|Endoftext|>"]
    assert [x.tolist() for x in encoder.batch(pa.array([*every, None]))] == [ids_of(library, t) for t in [*every, None]]
    # a word takes one entry of the memo, in capitals, with stops or at a line's end
    known = [encoder.memo.text[a:z].tobytes() for a, z in zip(encoder.memo.text_ends, encoder.memo.text_ends[1:], strict=False)]
    assert [x for x in known if b"word" in x.lower()] in ([b"word", b"''word"], [b"''word", b"word"])
    # letters beside stops, before marks and in capitals
    rnd = random.Random(3)
    around = ["", ".", "'", "'s", "1", "<", "a", "A", "\u0307", "\u030c", "\n", "\x1f", "\x85", "”"]
    chars = [chr(c) for c in [*range(0x20, 0x500), 0x1E9E, 0x2019, 0x212A, 0x3042, 0xFF21]]
    every = [f"{a}{c}{z}" for c in chars for a, z in [(".", "."), ("a", "."), ("'", "s"), *((rnd.choice(around), rnd.choice(around)) for _ in range(6))]]
    assert [x.tolist() for x in encoder.batch(pa.array(every))] == [ids_of(library, t) for t in every]


def test_decoder_streams_characters_as_they_become_whole():
    machine = byte_bpe.decoder(MULTI)
    machine.reset()
    raw = "a😀é".encode()
    single = [byte_bpe.ranks(MULTI)[raw[i : i + 1]] for i in range(len(raw))]
    assert [machine.feed(np.array([i])).decode() for i in single] == ["a", "", "", "", "😀", "", "é"]
    assert machine.feed(np.array(single[1:3])) == b"" and machine.end() == raw[1:3]
    rnd = random.Random(1)
    for _ in range(300):
        raw = b"".join(rnd.choice(["é".encode(), "😀".encode(), b"a", b"\xe2", b"\xff", b"\xf0\x9f", b"\x80"]) for _ in range(12))
        ids, out, at = [byte_bpe.ranks(MULTI)[raw[i : i + 1]] for i in range(len(raw))], [], 0
        while at < len(ids):
            n = rnd.randint(1, 5)
            out.append(machine.feed(np.array(ids[at : at + n])))
            at += n
        out.append(machine.end())
        # malformed bytes pass, and no character is cut
        assert b"".join(out) == raw and "".join(x.decode("utf-8", "replace") for x in out) == raw.decode("utf-8", "replace")


def test_round_trip(docs, nothing):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(MULTI), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = byte_bpe.round_trip(docs, MULTI).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id]) and bytes(r.data).decode() == texts[r.doc_id]
    assert byte_bpe.decoded(byte_bpe.encoded(docs, MULTI), MULTI).count() == len(rows) and byte_bpe.round_trip(nothing, MULTI).count() == 0


def test_heap_counts(docs, nothing):
    library = Tokenizer.from_file(JSON)
    for r in token_counts.token_counts(docs, JSON).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(ids_of(library, r.text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert token_counts.token_counts(nothing, JSON).count() == 0


def test_pack_round_trip():
    rnd = np.random.default_rng(1)
    for values in (np.array([], np.uint32), np.array([0, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1], np.uint32), rnd.integers(0, 49408, 1001).astype(np.uint32)):
        assert (token_file.unpack(*token_file.pack(values), len(values)) == values).all()


def test_token_file(spark, docs, nothing):
    library = Tokenizer.from_file(WORD)
    for d in (docs, nothing):
        path = f"{shared_dir(spark)}/file-{d.count()}"
        token_file.write(saved(token_file.encoded(d.withColumn("width", F.lit(1)), library_tokens.word_level, WORD, 2), "ids"), path)
        rows = token_file.read(spark, path).collect()
        rows.sort(key=lambda r: r.start)
        assert len(rows) == d.count()
        keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
        assert keys == sorted(keys)
        texts = {r.doc_id: r.text for r in d.collect()}
        at = 0
        for r in rows:
            assert r.start == at
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids == ids_of(library, texts[r.doc_id]) + [2]
            at += len(ids)


def test_packing(docs, nothing):
    library = Tokenizer.from_file(JSON)
    rows = packing.packed(docs, JSON, capacity=256).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids = np.array(ids_of(library, text) + [0], "<u4")
        mine = sorted(by_doc[d], key=lambda r: (r.piece, r.sequence_id))
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 256 or r.piece == 0
        copies = 2 if d == 3 else 1
        assert sum(r.length for r in mine) == copies * len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.packed(nothing, JSON).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_every_piece_and_is_near_the_bound(seed):
    rnd = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.clip(rnd.lognormal(5, 1, 3000), 1, 2048).astype(int), return_counts=True), strict=True)}
    planned = packing.plan(histogram)
    held = {}
    for made, n in planned:
        assert sum(made) <= 2048
        for x in made:
            held[x] = held.get(x, 0) + n
    assert held == histogram
    bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert sum(n for _, n in planned) <= 1.01 * bound + 1
    # without small pieces no sequence can be filled up
    assert sum(n for _, n in packing.plan({1100: 10, 1000: 10})) == 10 + 5


def test_program_places_the_pieces(monkeypatch):
    rnd = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.clip(rnd.lognormal(6, 1, 3000), 1, 2048).astype(int), return_counts=True), strict=True)}
    left_over, best_fit = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda lengths, counts, capacity: left_over.append(int(lengths @ counts)) or best_fit(lengths, counts, capacity))
    packing.plan(histogram)
    assert max(left_over) <= 0.2 * sum(k * n for k, n in histogram.items())


def test_program_is_proved_by_prices():
    for histogram, want in (({1000: 10, 1100: 10}, 15), ({1: 1, 700: 3, 1500: 4}, 6), ({2048: 7}, 7)):
        lengths, counts = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
        used, bound = packing.solved(lengths, counts, 2048)
        held = np.zeros(len(lengths), int)
        for made, times in used.items():
            for k, n in made:
                held[k] += n * times
        assert held.tolist() == counts.tolist() and sum(used.values()) == want and want - 1 < bound <= want + 1e-6
