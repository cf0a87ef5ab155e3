"""Crawl, rotated logs, exports and ground truth."""

import os

import pytest
from pyspark.sql import functions as F

from skarn.sources import files as FS
from skarn.sources.shared import scratch


def test_crawl_prunes_and_reads_all(spark, tmp_path):
    kept = {"a.py": "x = 1", "src/b.ts": "let b", "src/deep/er/c.JS": "", "src/d.txt": "no", "src/noext": "no", "lib/e.rs": "é" * 10}
    gone = {"node_modules/x/y.py": "no", "src/dist/z.ts": "no", "lib/skip.py": "no"}
    for p, t in (kept | gone).items():
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text(t)
    os.makedirs(tmp_path / "empty")
    # A folder that is ignored is never opened.
    os.makedirs(tmp_path / "locked")
    os.chmod(tmp_path / "locked", 0)
    for parts in (1, 3, 50):
        got = FS.crawled(spark, f"file://{tmp_path}", ["node_modules", "dist/", "lib/skip.py", "/locked"], parts).collect()
        assert {(r.relative_path, r.content, r.size) for r in got} == {(p, t, len(t.encode())) for p, t in kept.items() if p.rpartition(".")[2].lower() in ("py", "ts", "js", "rs")}
    os.chmod(tmp_path / "locked", 0o700)
    assert {r.language for r in got} == {"python", "typescript", "javascript", "rust"}
    assert FS.crawled(spark, f"file://{tmp_path}/empty").count() == 0


def test_tree_round_trip(spark):
    root = scratch(spark, "tree")
    rows = [("a/b/c.py", "one"), ("d.go", None)]
    assert {tuple(r) for r in FS.write_tree(spark.createDataFrame(rows, "relative_path string, content string"), root).collect()} == {("a/b/c.py", 3), ("d.go", 0)}
    assert {(r.relative_path, r.content) for r in FS.crawled(spark, root).collect()} == {("a/b/c.py", "one"), ("d.go", "")}


def test_rotation_counts_bytes(spark):
    rows = [(i, "é" * (i % 7) + "x") for i in range(200)]
    got = {r.i: r.file for r in FS.rotated(spark.createDataFrame(rows, "i int, line string"), "i", most=50, before=13).collect()}
    at = 13
    for i, line in rows:
        assert got[i] == at // 50
        at += len(line.encode()) + 1


def test_rotated_files_are_read_in_order(spark):
    path = scratch(spark, "log")
    lines = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.when(F.col("id") % 10 == 3, "").otherwise("}")).alias("line"))
    FS.append_rotated(lines(0, 60), path, "id", most=100)
    FS.append_rotated(lines(60, 100), path, "id", most=100)
    got = FS.read_rotated(spark, path, "id long").collect()
    assert {r.id for r in got} == {i for i in range(100) if i % 10 != 3}
    by_file = [r.id for r in sorted(got, key=lambda r: (r.file, r.id))]
    assert by_file == sorted(by_file) and len({r.file for r in got}) > 5


def test_csv_of_odd_records(spark):
    rows = [(1, '{"b":1.5,"a":null}'), (2, '{"c":{"x":[1,2]},"a":"q\\"t,\\n"}'), (3, "{}"), (4, None)]
    got = [r.line for r in FS.csv_export(spark.createDataFrame(rows, "n int, json string"), "n").orderBy("line_no").collect()]
    assert got == ["a,b,c", ",1.5,", '"q""t,\n",,"{""x"":[1,2]}"', ",,", ",,"]
    assert FS.csv_export(spark.createDataFrame([], "n int, json string"), "n").count() == 0


def test_truth_parts(spark):
    path = scratch(spark, "truth")
    with pytest.raises(ValueError):
        FS.save_truth({"other": spark.range(1)}, path)
    FS.save_truth({"symbols": spark.createDataFrame([("a", None), ("b", "hard")], "id string, difficulty string")}, path)
    parts = FS.load_truth(spark, path, {"symbols": "id string, difficulty string, tags array<string>"}, {"difficulty": "medium"})
    assert set(parts) == set(FS.TRUTH_PARTS) and parts["cycles"].count() == 0
    assert {(r.id, r.difficulty, r.tags) for r in parts["symbols"].collect()} == {("a", "medium", None), ("b", "hard", None)}


def test_a_rotated_log_is_few_folders(spark):
    """thousands of small files lie in few folders, none of them alone in one; bytes that are there count, and lines longer
    than a chunk stay whole."""
    path = scratch(spark, "small-log")
    lines = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"t":"é"}')).alias("line"))
    FS.append_rotated(lines(0, 3000), path, "id", most=30)
    FS.append_rotated(lines(3000, 5000), path, "id", most=30)
    at, want = 0, set()
    for i in range(5000):
        want.add((i, f"{at // 30:012}"))
        at += len(f'{{"id":{i},"t":"é"}}'.encode()) + 1
    assert {(r.id, r.file) for r in FS.read_rotated(spark, path, "id long, t string").collect()} == want
    root = path.removeprefix("file://")
    folders = os.listdir(root)
    assert len({f for _, f in want}) > 3000 and len(folders) == at // 30 // FS.FOLDER + 1 and all(os.path.isdir(f"{root}/{f}") for f in folders)
    long = spark.createDataFrame([(1, '{"id":1,"t":"' + "é" * FS.CHUNK + '"}'), (2, None), (3, '{"id":3,"t":"x"}')], "id int, line string").fillna("", ["line"])
    FS.append_rotated(long, scratch_ := scratch(spark, "long-log"), "id", most=50)
    assert {(r.id, len(r.t)) for r in FS.read_rotated(spark, scratch_, "id long, t string").collect()} == {(1, FS.CHUNK), (3, 1)}
