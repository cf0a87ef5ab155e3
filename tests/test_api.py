import pytest
from pyspark.sql import functions as F

from skarn.api import Engine, Tasks


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame([("src/index.ts", "typescript", "export function alphaBeta() {}\n// gamma", "h1", 40), ("src/b.py", "python", "def delta(): pass", "h2", 17), ("lib/c.py", "python", "alpha = 1", "h3", 9)], "relative_path string, language string, content string, hash string, size long")
    return Engine(files, spark.createDataFrame([("src/b.py", "h2"), ("lib/c.py", "old"), ("gone.py", "x")], "relative_path string, hash string"))


@pytest.mark.parametrize("mode", ["semantic", "keyword", "hybrid"])
def test_search(spark, engine, mode):
    q = spark.createDataFrame([(1, "alpha beta gamma")], "query_id int, query string")
    assert engine.search(q, mode=mode).orderBy("rank").first().relative_path == "src/index.ts"
    assert {r.relative_path for r in engine.search(q, mode=mode, language="python").collect()} <= {"src/b.py", "lib/c.py"}
    assert {r.relative_path for r in engine.search(q, mode=mode, include=["lib/**"], ranking=True).collect()} <= {"lib/c.py"}


def test_bad_mode(spark, engine):
    with pytest.raises(ValueError):
        engine.search(spark.range(1), mode="other")


def test_plan_and_index(engine):
    assert dict(engine.plan().collect()) == {"src/index.ts": "add", "lib/c.py": "update", "gone.py": "delete"}
    assert engine.plan(force=True).count() == 3
    index = engine.index()
    assert {r.relative_path for r in index.manifest.collect()} == {"src/index.ts", "lib/c.py"}
    assert index.chunks.count() == 2 and index.postings.where("term = 'alpha'").count() == 2


def test_views(spark, engine):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {r.node for r in engine.dependencies(edges, ["a"]).collect()} == {"a", "b", "c"}
    s = engine.summarize(edges, 5).first()
    assert (s.files, s.roots, s.over_budget) == (3, 1, True)
    assert engine.stats().where("language is null").first().files == 3
    defs = spark.createDataFrame([("m.f", "f")], "fqn string, name string")
    sites = spark.createDataFrame([("f", "main"), ("g", "f")], "name string, caller string")
    assert [r.caller for r in engine.xrefs(defs, sites, "f").collect()] == ["main"]
    assert [r.name for r in engine.xrefs(defs, sites, "f", "callees").collect()] == ["g"]


def test_tasks(spark):
    log = spark.createDataFrame([("r", None, "root", "running", 1), ("c", "r", "child", "pending", 1), ("g", "c", "leaf", "pending", 1)], "id string, parent_id string, label string, status string, seq int")
    t = Tasks(log).crashed()
    assert {r.id: r.status for r in t.current().collect()} == {"r": "failed", "c": "pending", "g": "pending"}
    t = t.delete(spark.createDataFrame([("c",)], "id string"), cascade=True)
    assert [r.id for r in t.tree().collect()] == ["r"] and t.counts().select(F.sum("n")).first()[0] == 1
