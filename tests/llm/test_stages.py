import random
import re

import corpus_pipeline
from quarrylog.llm import jaccard_join, line_dedup, packing, quality
from quarrylog.llm.common import saved

WORD = re.compile(r"[^\x20\x09-\x0D]")


def test_stages_keep_the_columns_and_take_effect(spark, docs, nothing, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "pii", "packing"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for at in (docs, nothing):
        texts = at.select("doc_id", "text")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, at = at, saved(stage(spark, at, str(tmp_path)), name)
            assert at.columns == docs.columns and at.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
            ids = {r.doc_id for r in before.collect()}
            if name == "quality_rules":
                want = {r.doc_id for r in quality.judged(quality.ledger(before)).where("kept").collect()}
            elif name == "line_dedup":
                left = {r.doc_id: r.text for r in line_dedup.line_dedup(before).collect()}
                want = {i for i in ids if WORD.search(left[i])}
                assert {r.doc_id: r.text for r in at.collect()} == {i: left[i] for i in want}
            elif name == "jaccard_join":
                want = {r.doc_id for r in jaccard_join.joined(texts, before).collect() if r.component_id == r.doc_id} & ids | ids & {None}
            else:
                want = ids
            assert {r.doc_id for r in at.collect()} == want
        packed = corpus_pipeline.STAGES[-1][1](spark, at, "")
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in at.collect()}


def test_one_of_each_group_of_copies_and_no_blank_document(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(10)) for _ in range(6)]
    rows = dict(enumerate(texts))
    for i in range(3):
        rows[10 + i] = texts[i]  # exact copies
        edited = texts[i].split(" ")
        edited[30] = "edited"
        rows[20 + i] = " ".join(edited)  # near copies, which keep one line of their own
    rows[30] = "short text"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(range(6)) and all(r.length > 50 for r in pieces)
    places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:], strict=False)) and max(r.offset + r.length for r in pieces) <= packing.CAPACITY


def test_near_copies_but_for_lines_that_line_dedup_takes(spark, tmp_path):
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    frames, body = [words(80) for _ in range(2)], words(120)
    edited = body.split(" ")
    edited[60] = "edited"
    # 1 and 2 hold the lines first; 3 and 4 are near copies of each other without them only
    rows = {1: f"{frames[0]}\n{words(90)}", 2: f"{frames[1]}\n{words(90)}", 3: f"{frames[0]}\n{body}", 4: f"{frames[1]}\n{' '.join(edited)}"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = saved(corpus_pipeline.line_stage(spark, docs, str(tmp_path)), "left")
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, left, str(tmp_path)).collect()} == {1, 2, 3}
