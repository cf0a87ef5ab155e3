"""Task spawning, the stored tool cache, registries, summaries and cross-validation."""

import pytest
from pyspark.sql import functions as F

from skarn.api import Tasks, ToolCache
from skarn.operators import evaluation, registries, summary, xref
from skarn.sources.versions import Versions

LOG = "id string, parent_id string, label string, status string, seq int"


def test_spawn_follows_parents(spark):
    tasks = Tasks(spark.createDataFrame([("r", None, "root", "running", 3), ("old", "r", "x", "deleted", 1)], LOG))
    rows = [("a", "r", "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "nobody", "D"), ("e", "d", "E"), ("r", None, "again"), ("f", "old", "F"), ("g", None, "G"), ("twin", "r", "1"), ("twin", "r", "2"), ("x", "y", "X"), ("y", "x", "Y")]
    now, refused = tasks.spawn(spark.createDataFrame(rows, "id string, parent_id string, label string"))
    assert {r.id: r.status for r in now.current().collect()} == {"r": "running", "a": "pending", "b": "pending", "c": "pending", "g": "pending"}
    assert {r.id for r in refused.collect()} >= {"d", "e", "f", "twin", "x", "y"}
    done = now.update(spark.createDataFrame([("a", "completed")], "id string, status string"))
    assert done.current().where("id = 'a'").first().status == "completed"


def test_tool_cache(spark):
    cache = ToolCache(Versions(spark, buckets=3))
    rows = lambda *r: spark.createDataFrame(list(r), "task string, tool string, output string, cached_at long")
    ask = lambda *r: {(x.task, x.tool): (x.output, x.hit) for x in cache.get(spark.createDataFrame(list(r), "task string, tool string")).collect()}
    assert ask(("t", "grep")) == {("t", "grep"): (None, False)}
    cache.put(rows(("t", "grep", "one", 1), ("t", "grep", "two", 2), ("t", "read", None, 1), ("tg", "rep", "other", 1), (None, "grep", "lost", 1)))
    assert ask(("t", "grep"), ("t", "read"), ("tg", "rep")) == {("t", "grep"): ("two", True), ("t", "read"): (None, True), ("tg", "rep"): ("other", True)}
    cache.put(rows(("t", "grep", "three", 3)))
    cache.clear(spark.createDataFrame([("tg",)], "task string"))
    assert ask(("t", "grep"), ("t", "read"), ("tg", "rep")) == {("t", "grep"): ("three", True), ("t", "read"): (None, True), ("tg", "rep"): (None, False)}


def test_validators(spark):
    own = registries.Registry("validator")
    own.register("x")(lambda c: registries.message("error", "has x", F.contains(c, F.lit("x"))))
    with pytest.raises(LookupError):
        own.of("y")
    registries.VALIDATORS.register("t_long")(lambda c: registries.message("warning", F.format_string("%d", F.length(c)), F.length(c) > 3))
    registries.VALIDATORS.register("t_x")(own.of("x"))
    df = spark.createDataFrame([(1, "axxx", "kept"), (2, "ab", "kept"), (3, None, "kept"), (4, "abcde", "kept")], "id int, content string, errors string")
    got = {r.id: (r.errors, r.warnings, r.passed, [(f.validator, f.message) for f in r.findings]) for r in registries.validated(df, ["t_long", "t_x"]).collect()}
    assert got == {1: (1, 1, False, [("t_long", "4"), ("t_x", "has x")]), 2: (0, 0, True, []), 3: (0, 0, True, []), 4: (0, 1, True, [("t_long", "5")])}
    assert registries.validated(df, []).where("passed").count() == 4
    registries.VALIDATORS.drop("t_long")
    with pytest.raises(LookupError):
        registries.validated(df, ["t_long"])


def test_policies(spark):
    registries.POLICIES.register("t_hours")(lambda: F.col("hour").between(9, 17))
    roles = spark.createDataFrame([("dev", "t_hours")], "role string, policy string")
    asks = spark.createDataFrame([("u", "dev", 10), ("v", "dev", 3), ("w", "dev", None), ("x", "ops", 10)], "user string, role string, hour int")
    assert {r.user: r.passes for r in registries.policies_pass(roles, asks).collect()} == {"u": True, "v": False, "w": False}
    with pytest.raises(LookupError):
        registries.policies_pass(spark.createDataFrame([("dev", "t_none")], "role string, policy string"), asks)


def test_languages(spark):
    def lines(files):
        defs = files.select("relative_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^sub (\w+)"), F.lit(1))).alias("name"))
        none = F.array().cast("array<string>")
        defs = defs.select("relative_path", "name", F.lit("function").alias("type"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array("name").alias("scope"), F.col("name").alias("fqn"), none.alias("calls"))
        return defs, files.sparkSession.createDataFrame([], "relative_path string, i int, name string, line int, receiver string, caller string")

    registries.LANGUAGES.register("t_perl")(lines)
    try:
        files = spark.createDataFrame([("a.pl", "t_perl", "sub one\nsub two"), ("b.ts", "typescript", "function three() {}"), ("c.zz", "unknown", "function no() {}")], "relative_path string, language string, content string")
        defs, sites = registries.references(files)
        assert {(r.relative_path, r.fqn) for r in defs.collect()} == {("a.pl", "one"), ("a.pl", "two"), ("b.ts", "three")} and sites.count() == 0
    finally:
        registries.LANGUAGES.drop("t_perl")


def test_summary_by_hand(spark):
    code = {"app/index.ts": "export function run() { helper(); only(); }", "app/util/helper.ts": "function helper() {}", "app/x.test.ts": "function t() { run(); }", "lib/b.ts": "function only() {}", "lib/a.test.ts": "", "top.ts": "function outside() {}"}
    files = spark.createDataFrame(list(code.items()), "relative_path string, content string")
    defs, sites = xref.references(files)
    edges = summary.dependencies(defs, sites)
    assert {tuple(r) for r in edges.collect()} == {("app/index.ts", "app/util/helper.ts"), ("app/index.ts", "lib/b.ts"), ("app/x.test.ts", "app/index.ts")}
    got = summary.summarized(files, defs, edges, 20).orderBy("scope", "upto").collect()
    assert [(r.scope, r.part, r.text) for r in got] == [
        ("app", "architecture", "files 3, symbols 3, dependencies 3, roots 1, leaves 1"), ("app", "entry", "app/index.ts"), ("app", "export", "app/index.ts function:run"), ("app", "leaf", "app/util/helper.ts"),
        ("lib", "architecture", "files 2, symbols 1, dependencies 0, roots 1, leaves 2"), ("lib", "entry", "lib/b.ts"), ("lib", "export", "lib/b.ts function:only"), ("lib", "leaf", "lib/a.test.ts"), ("lib", "leaf", "lib/b.ts"),
    ]
    assert [r.kept for r in got] == [r.upto <= 20 for r in got] and not got[0].within
    assert summary.summarized(files, defs, edges, 10_000).where("kept and within").count() == 9


def test_cross_validation(spark):
    df = spark.range(50).withColumn("y", F.col("id") * 2.0)
    seen = []

    def score(train, test):
        seen.append((train.count(), {r.id for r in test.collect()}))
        return float(test.agg(F.avg("y")).first()[0])

    scores, mean, deviation = evaluation.cross_validated(df, "id", 4, score)
    assert [n for n, _ in seen] == [38, 38, 38, 36] and set().union(*(t for _, t in seen)) == set(range(50))
    assert len(scores) == 4 and abs(mean - sum(scores) / 4) < 1e-9 and deviation >= 0


def test_bootstrap_spreads_its_draws(spark, monkeypatch):
    """Draws are rounds times rows: the number of tasks that make them grows with both, and the result does not change."""
    df = spark.range(50).select("id", (F.col("id") * 1.5).alias("v"))
    want = evaluation.bootstrap(df, "v", "id", rounds=100).first()
    monkeypatch.setattr(evaluation, "DRAWS", 500)
    got = evaluation.bootstrap(df, "v", "id", rounds=100)
    assert "Repartition 10, true" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [round(x, 9) for x in got.first()] == [round(x, 9) for x in want]


def test_neighbours_meet_in_cells(spark, monkeypatch):
    """odd vectors, equal ones and ties, in cells smaller than the tables; no pair is made outside of them."""
    from skarn.operators import vector
    from skarn.operators.search import top

    monkeypatch.setattr(vector, "PART", 40)
    monkeypatch.setattr(vector, "BLOCK", 7)
    monkeypatch.setattr(vector, "TILE", 64)
    odd = [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 1.0, 2.0]), (303, [float("inf"), 1.0, 0.0]), (304, [1.0, 2.0]), (305, []), (306, [1e-6, 0.0, 0.0]), (307, [-0.0, 0.0, 0.0])]
    v = spark.createDataFrame([(i, [float(i * (j + 3) % 5) for j in range(3)]) for i in range(200)] + odd, "doc_id long, vector array<float>")
    q = v.where("doc_id % 9 = 0 or doc_id >= 300").select(F.col("doc_id").alias("query_id"), "vector")
    pairs = v.crossJoin(q.withColumnRenamed("vector", "q")).select("query_id", "doc_id", F.round(1 - vector.squared_distance("vector", "q"), vector.DIGITS).alias("score"))
    for k in (1, 12, 300):
        assert sorted(map(repr, vector.knn(v, q, k).collect())) == sorted(map(repr, top(pairs, k).select("query_id", "rank", "doc_id", "score").collect()))
    clean = v.where("doc_id < 200")
    assert "FlatMapCoGroupsInArrow" in vector.knn(clean, q.where("query_id < 200"))._jdf.queryExecution().optimizedPlan().toString()


def test_index_counts_in_the_row(spark, tmp_path):
    """A corpus with equal texts, ids that stand twice and an empty text, by the SQL; occurrences are made
    without a shuffle."""
    import duckdb

    from skarn.operators import search
    from skarn.plans import ORACLES, QUERIES

    words = ["alpha", "beta", "gammaDelta", "eps_1", "zeta", "x"]
    docs = [(i, " ".join(words[(i * j) % 6] for j in range(i % 23)), "en") for i in range(300)] + [(1000 + i, "alpha beta alpha", "en") for i in range(100)] + [(7, "zeta alpha", "en"), (7, "beta", "en"), (2001, "", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(words[i % 6 :] + words[: i % 3] * 2)) for i in range(300)] + [(500, ""), (501, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("tx01_bm25", "tx02c_index_tables"):
        got = QUERIES[name](spark, str(tmp_path))
        rel = con.sql(ORACLES[name])
        assert sorted(tuple(r) for r in got.select(rel.columns).collect()) == sorted(rel.fetchall())
    unique = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id <> 7").coalesce(4)
    plan = search.occurrences_of(unique, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_summaries_read_each_file_once(spark):
    """the summary of files' outlines is the one of their definitions and sites, from one reading; a path may come twice."""
    from skarn.plans import QUERIES

    code = {"app/index.ts": "export function run() { helper(); only(); }\nclass K { m0() {} }", "app/util/helper.ts": "function helper() {}", "app/x.test.ts": "function t() { run(); }", "lib/b.ts": "function only() { only(); twice(); }", "lib/a.test.ts": "", "lib/null.ts": None, "top.ts": "function outside() {} helper();", "big/f.ts": "\n".join(f"function f{i % 7}{i % 3}() {{ twice(); const a{i} = () => {{}}; }}" for i in range(30))}
    files = spark.createDataFrame([*code.items(), ("lib/c.ts", "function twice() {}"), ("lib/c.ts", "function twice() { run(); } function early() {}")], "relative_path string, content string")
    defs, sites = xref.references(files)
    for budget in (20, 10_000):
        want = summary.summarized(files, defs, summary.dependencies(defs, sites), budget)
        got = summary.outlined(xref.outlines(files.where("relative_path <> 'lib/c.ts'"), summary.EXPORTS).unionByName(xref.outlines(files.where("relative_path = 'lib/c.ts'"), summary.EXPORTS)), budget)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("part = 'export'").count() == 15
    plan = QUERIES["gr15b_summary_short"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # what is left reads the written outlines
