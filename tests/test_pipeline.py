import gzip
import io
import json
import lzma
import random

import duckdb
import pytest

from quarrylog import queries
from quarrylog.cli import main
from quarrylog.operators import index
from quarrylog.operators.records import records
from quarrylog.settings import DEFAULTS
from quarrylog.sources import text
from quarrylog.streaming import follow

FORMAT = ["-t", "%Y-%m-%d %T.%3N"]
M2 = '{"level":"debug","ts":"2031-03-02T07:45:12.250+02:00","msg":"second thing"}'
M1 = '{"level":"debug","ts":"2031-03-02T07:44:01.125+02:00","msg":"first thing"}'
SHOWN = ["2031-03-02 05:44:01.125 [DBG] first thing", "2031-03-02 05:45:12.250 [DBG] second thing"]


def shown(spark, tmp_path, content, *args):
    path = tmp_path / "in.log"
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    out = io.StringIO()
    main([*FORMAT, *args, str(path)], spark, out)
    return out.getvalue().splitlines()


def test_sort_and_cat(spark, tmp_path):
    assert shown(spark, tmp_path, f"{M2}\n\r\n{M1}\n", "-s") == SHOWN
    assert shown(spark, tmp_path, M2 + M1 + "\n") == SHOWN[::-1]
    assert shown(spark, tmp_path, M2 + "{nothing here" + M1 + "\n") == [SHOWN[1], "{nothing here" + M1]
    assert shown(spark, tmp_path, f"{M2}\n{M1}\n", "-q", 'msg="first thing"') == SHOWN[:1]
    assert shown(spark, tmp_path, f"{M2}\n{M1}\n", "-r", "--tail", "1") == [M1]


@pytest.mark.parametrize("pack", [gzip.compress, lzma.compress])
def test_compressed_by_content(spark, tmp_path, pack):
    assert shown(spark, tmp_path, pack(f"{M2}\n{M1}\n".encode()), "--delimiter", "newline") == SHOWN[::-1]


def test_hide_and_pass_through(spark, tmp_path):
    line = "disk.io.read=7 disk.io.write=8 disk.free=9\n"
    assert shown(spark, tmp_path, line, "-h", "disk.io")[0].endswith("disk.free=9 ...")
    assert shown(spark, tmp_path, line, "-h", "disk.io", "-h", "!disk.io.write")[0].endswith("disk.io.write=8 disk.free=9 ...")
    assert shown(spark, tmp_path, "free text\n") == ["free text"]
    assert shown(spark, tmp_path, "free text\n", "-l", "info") == []


def test_delimiters():
    split = lambda d, s: [x.decode() for _, x in text.splitter(d)(s.encode())]
    assert split("pretty", '{\n "a":1\n}\nx\r\ny') == ['{\n "a":1\n}', "x", "y"]
    assert split("json", '{"a":\n{"b":1}}\n{"c":[\n{},\n{}]}') == ['{"a":\n{"b":1}}', '{"c":[\n{},\n{}]}']
    assert split("newline", "a\rb\r\nc\n") == ["a\rb", "c"]
    assert split("nul", "a\0b\0") == ["a", "b"]
    assert text.delimiter_for("json", True) == "newline" and text.delimiter_for() == "pretty"


@pytest.mark.parametrize("delimiter", ["pretty", "json", "newline", "crlf"])
def test_many_splits_equal_one(spark, tmp_path, delimiter):
    rnd = random.Random(6)
    files = []
    for n in range(2):
        rows = []
        for i in range(700):
            body = json.dumps({"i": i, "text": "é" * rnd.randint(0, 40), "list": [1, {"a": 2}]}, ensure_ascii=False, indent=rnd.choice([None, 1]))
            rows.append(rnd.choice([body, body, f"plain {i}", f"trace {i}\n\tat x\n  at y", "", " "]))
        data = "".join(x + rnd.choice(["\n", "\r\n"]) for x in rows).encode() + b"broken \xff end"
        (tmp_path / f"{n}.log").write_bytes(data)
        files.append(data)
    (tmp_path / "2.log").write_bytes(gzip.compress(files[0]))
    want = [(n, x.decode("utf-8", "replace")) for n, data in enumerate([*files, files[0]]) for _, x in text.splitter(delimiter)(data)]
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = text.entries(spark, [str(tmp_path / "?.log")], delimiter).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    rows.sort(key=lambda r: (r.input_id, r.offset))
    assert len({(r.input_id, r.offset) for r in rows}) == len(rows)
    assert [(r.input_id, r.raw) for r in rows] == want


def test_output_file_and_stdin(spark, tmp_path):
    (tmp_path / "in.log").write_text(f"{M2}\n{M1}\n")
    main([*FORMAT, "-s", "-o", str(tmp_path / "out.txt"), str(tmp_path / "in.log")], spark)
    assert (tmp_path / "out.txt").read_text().splitlines() == SHOWN
    rows = text.stdin_entries(spark, io.BytesIO(f"{M2}\n{M1}\n".encode())).collect()
    assert [r.raw for r in rows] == [M2, M1] and {r.input_name for r in rows} == {"-"}


def test_index_is_kept_and_reused(spark, tmp_path):
    log, kept = tmp_path / "a.log", tmp_path / "index"
    line = lambda i, level: json.dumps({"ts": f"2031-03-02T{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}Z", "level": level, "msg": "x" * 400}) + "\n"
    first = "".join(line(i, "error" if i == 20 else "info") for i in range(5000))
    log.write_text(first)
    run = lambda *a: (out := io.StringIO()) and main([*FORMAT, *a, str(log)], spark, out) == 0 and out.getvalue().splitlines()
    plain, indexed = run("-s", "-l", "error"), run("-s", "-l", "error", "--index", str(kept))
    assert plain == indexed and len(plain) == 1
    dump = [json.loads(x) for x in run("--dump-index", "--index", str(kept))]
    assert [x["block_no"] for x in dump] == [0, 1, 2] and sum(x["entries_valid"] for x in dump) == 5000 and [x["flags"] & 8 for x in dump] == [8, 0, 0]
    log.write_text(first + line(6000, "error"))
    parsed = []
    old = spark.read.parquet(sorted(str(x) for x in kept.glob("*/*"))[-1])
    now = index.built(text.entries(spark, [str(log)]), lambda e: parsed.append(e) or records(e, DEFAULTS), old)
    assert {r.block_no for r in index.in_blocks(parsed[0]).select("block_no").distinct().collect()} == {2}
    assert [r.entries_valid for r in now.orderBy("block_no").collect()][:2] == [x["entries_valid"] for x in dump][:2]
    assert len(run("-s", "-l", "error", "--index", str(kept))) == 2


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        text.entries(spark, ["/nowhere/x.log"])


def test_follow_merges_marks_late_rows_and_keeps_offsets(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("old1\nold2\nold3\n")
    b.write_text("")
    reader = follow.AppendedLinesReader({"path": f"{a},{b}", "tail": "2"})
    at = reader.initialOffset()
    rows, at = reader.read(at)
    assert [r[3] for r in rows] == ["old2", "old3"]
    with open(a, "a") as f:
        f.write("new\npart")
    rows, after = reader.read(at)
    assert [r[3] for r in rows] == ["new"]
    assert [r[3] for r in reader.readBetweenOffsets(at, after)] == ["new"]
    a.write_text("x\n")
    rows, _ = reader.read(after)
    assert [r[3] for r in rows] == ["x"]

    out = []
    merge = follow.Merger(out.extend)
    schema = "input_id int, offset long, rec_no int, ts_sec long, ts_nsec int, raw string"
    merge(spark.createDataFrame([(0, 0, 0, 200, 0, "a200"), (1, 0, 0, 100, 0, "b100"), (1, 5, 0, None, None, "gap")], schema))
    merge(spark.createDataFrame([(1, 9, 0, 50, 0, "late")], schema))
    assert [(r["raw"], r["in_sync"]) for r in out] == [("gap", True), ("b100", True), ("a200", True), ("late", False)]


def test_follow_runs_as_a_stream(spark, tmp_path):
    from quarrylog.operators.records import records
    from quarrylog.settings import DEFAULTS

    path = tmp_path / "s.log"
    path.write_text(f"{M2}\n{M1}\n")
    out = []
    query = follow.run(records(follow.follow(spark, [str(path)]), DEFAULTS), out.extend, "200 milliseconds", str(tmp_path / "state"))
    try:
        for _ in range(60):
            if out:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert [r["message"]["text"] for r in out] == ["first thing", "second thing"] and all(r["in_sync"] for r in out)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(queries.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(tuple(r[i] for i in order) for r in want)
