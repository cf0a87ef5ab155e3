"""Published versions, plans from histories, and the engine's index kept up to date."""

import random

import pytest

from skarn.api import Engine
from skarn.operators import incremental, vector
from skarn.sources.versions import Versions

LOG = "seq long, status string, path string, old_path string"


def simulated(log):
    """What a history does to files, one commit after the other."""
    alive, touched, base_gone, start = {}, set(), set(), {}
    commits = {}
    for seq, status, path, old in sorted(set(log), key=lambda x: (x[0], x[1], x[2], x[3] or "")):
        commits.setdefault(seq, []).append((status, path, old))

    def at(path):  # a path that nothing has touched yet is a file from before
        if path not in touched:
            touched.add(path)
            alive[path] = ("base", path)
        return alive.get(path)

    for seq in sorted(commits):
        lines, carried = commits[seq], {}
        for status, path, old in lines:
            if status == "D" and at(path):
                if alive[path][0] == "base":
                    base_gone.add(alive[path][1])
                del alive[path]
        for status, path, old in sorted((x for x in lines if x[0] == "R"), key=lambda x: (x[2], x[1])):
            if at(old):
                carried[path, old] = alive.pop(old)
        for status, path, old in sorted((x for x in lines if x[0] in "AR"), key=lambda x: x[2] or ""):
            touched.add(path)
            if path in alive and alive[path][0] == "base":
                base_gone.add(alive[path][1])
            alive[path] = carried.get((path, old), ("born", path)) if status == "R" else ("born", path)
        for status, path, old in lines:
            if status == "M":
                at(path)
    out = {("D", p, None) for p in base_gone}
    for path, (kind, first) in alive.items():
        out.add(("A", path, None) if kind == "born" else ("M", path, None) if path == first else ("R", path, first))
    return out


def test_net_changes_follow_chains(spark):
    log = [(1, "R", "b", "a"), (2, "R", "c", "b"), (3, "M", "c", None), (3, "A", "a", None), (4, "D", "x", None), (5, "A", "x", None), (6, "A", "t", None), (7, "R", "t2", "t"), (8, "D", "t2", None), (9, "R", "q", "p"), (9, "R", "p", "q")]
    log += [(100 + i, "R", f"n{i + 1}", f"n{i}") for i in range(20)]
    got = {tuple(r) for r in incremental.net_changes(spark.createDataFrame(log, LOG)).collect()}
    assert got == {("R", "c", "a"), ("A", "a", None), ("D", "x", None), ("A", "x", None), ("R", "q", "p"), ("R", "p", "q"), ("R", "n20", "n0")}


@pytest.mark.parametrize("seed", range(3))
def test_net_changes_against_a_simulation(spark, seed):
    rng = random.Random(seed)
    log = []
    for seq in range(60):
        # One line a commit and paths that often meet: chains, swaps, and lines that do not add up.
        status, path, old = rng.choice("AMDRR"), f"p{rng.randrange(9)}", f"p{rng.randrange(9)}"
        log.append((seq, status, path, old if status == "R" else None))
    log = [x for x in log if x[2] != x[3]]
    got = {tuple(r) for r in incremental.net_changes(spark.createDataFrame(log, LOG)).collect()}
    assert got == simulated(log)


def test_empty_history(spark):
    empty = spark.createDataFrame([], LOG)
    assert incremental.net_changes(empty).count() == 0
    files, manifest = spark.createDataFrame([("a",)], "relative_path string"), spark.createDataFrame([], "relative_path string")
    plan = incremental.git_plan(files, manifest, incremental.net_changes(empty))
    assert [tuple(r) for r in plan.collect()] == [("a", "add", "catch_all", None)]
    assert incremental.plan_stats(plan, files).first().asDict() == {"total": 1, "added": 0, "updated": 0, "deleted": 0, "caught": 1, "unchanged": 0}


def test_versions(spark):
    v = Versions(spark, buckets=4)
    assert v.latest() is None
    with pytest.raises(LookupError):
        v.table("a")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, n int")
    none = spark.createDataFrame([], "k string, m int")
    assert v.publish({"a": rows, "b": none, "w": rows}, {"a": "k", "b": "k"}) == 1
    before = {r.path for r in v._entries(1) if r.name == "a"}
    assert v.replace(spark.createDataFrame([("k1",)], "key string"), {"a": spark.createDataFrame([("k2", 200), ("k2", 201), ("new", 1)], "k string, n int")}) == 2
    assert v.table("a", 1).count() == 40 and v.table("a").count() == 41 and v.names() == ["a", "b", "w"]
    now = {(r.k, r.n) for r in v.table("a").collect()}
    assert {("k2", 200), ("k2", 201), ("new", 1)} <= now and not {("k1", 1), ("k2", 2)} & now
    after = {r.path for r in v._entries(2) if r.name == "a"}
    assert before & after and before - after  # only the touched buckets are new
    assert v.table("b").count() == 0 and v.table("w").count() == 40
    with pytest.raises(ValueError):
        v.replace(spark.createDataFrame([], "key string"), {"a": rows.withColumnRenamed("n", "other")})
    assert v.expire() and v.table("a").count() == 41


def test_a_run_that_ends_early_changes_nothing(spark, monkeypatch):
    v = Versions(spark, buckets=2)
    v.publish({"a": spark.createDataFrame([("x", 1)], "k string, n int")}, {"a": "k"})
    monkeypatch.setattr(v, "_commit", lambda entries: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        v.replace(spark.createDataFrame([("x",)], "key string"), {"a": spark.createDataFrame([("y", 2)], "k string, n int")})
    assert [tuple(r) for r in v.table("a").collect()] == [("x", 1)]


def test_engine_follows_files_and_filters_before_ranking(spark):
    made = lambda rows: spark.createDataFrame(rows, "relative_path string, language string, content string, hash string, size long")
    files = [(f"a/{i}.en", "en", f"licence terms licence {i}", f"h{i}", 1) for i in range(200)] + [(f"b/{i}.de", "de", f"some words and the licence once {i}", f"g{i}", 1) for i in range(4)]
    engine = Engine(made(files), embed=vector.embedder("hashing", 32), versions=Versions(spark, buckets=2))
    q = spark.createDataFrame([(1, "licence")], "query_id int, query string")
    for mode in ("keyword", "semantic", "hybrid"):
        assert {r.relative_path for r in engine.search(q, mode=mode, language="de").collect()} == {f"b/{i}.de" for i in range(4)}
    assert {r.relative_path for r in engine.search(q, mode="keyword", include=["b/**"]).collect()} == {f"b/{i}.de" for i in range(4)}
    changed = [f for f in files if f[0] != "b/0.de"] + [("b/9.de", "de", "licence licence licence", "new", 1)]
    changed[-2] = (changed[-2][0], "de", "nothing here", "other", 1)
    index = engine.update(made(changed))
    assert index.version == 2 and {r.relative_path for r in index.manifest.collect()} == {"b/3.de", "b/9.de"}
    assert {r.relative_path for r in engine.search(q, mode="keyword", language="de").collect()} == {"b/9.de", "b/1.de", "b/2.de"}
    assert engine.plan().count() == 0


def test_dimensions():
    assert [vector.resolved_dims(r, n) for r, n in ((256, 768), (1024, 768), (0, 768), (None, 512), (256, 0), (float("nan"), 384))] == [256, 768, 768, 512, 384, 384]


def test_staged_rows_are_written_once(spark, tmp_path):
    """Rows that other tables are made from are published where they lie, at first and when some are replaced."""
    v = Versions(spark, f"file://{tmp_path}/v", buckets=4)
    rows = v.staged("a", spark.range(100).selectExpr("concat('k', id % 10) as k", "cast(id as int) as n"), "k")
    assert rows.count() == 100
    v.publish({"a": rows, "b": rows.groupBy("k").count()}, {"a": "k", "b": "k"})
    assert len(list((tmp_path / "v" / "data").glob("a-*"))) == 1 and sorted(v.table("a").collect()) == sorted(rows.collect())
    fresh = v.staged("a", spark.createDataFrame([("k3", 1000), ("new", 1)], "k string, n int"), "k")
    v.replace(spark.createDataFrame([("k4",)], "key string"), {"a": fresh})
    want = [(f"k{i % 10}", i) for i in range(100) if i % 10 not in (3, 4)] + [("k3", 1000), ("new", 1)]
    assert sorted((r.k, r.n) for r in v.table("a").collect()) == sorted(want)
    v.replace(v.table("a").selectExpr("k as key").distinct(), {"a": v.staged("a", fresh.limit(0), "k")})
    assert v.table("a").count() == 0 and v.table("a").columns == ["k", "n"]
