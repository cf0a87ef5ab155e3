"""Exact values of single operators, and invariants of those without SQL."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.operators import chunk, evaluation, graph, incremental, registries, search, security, xref
from skarn.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("name, normal", [("getUserById", "get user by id"), ("XMLHttpRequest", "xml http request"), ("PARSE_JSON_DATA", "parse json data"), ("XMLParser_v2", "xml parser v 2"), ("user123", "user 123"), ("v2Parser", "v 2 parser"), ("", "")])
def test_normalize_symbol(spark, name, normal):
    assert one(spark, T.normalize_symbol(F.lit(name))) == normal


@pytest.mark.parametrize("a, b, n", [("cat", "bat", 1), ("cat", "cats", 1), ("hello", "", 5), ("getUser", "getUsr", 1), ("function", "funciton", 2), ("Hello", "hello", 1)])
def test_edit_distance(spark, a, b, n):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == n


def test_similarity_of_nothing(spark):
    assert one(spark, T.similarity(F.lit(""), F.lit(""))) == 1.0


def test_tokens_of_code(spark):
    assert one(spark, T.code_tokens(F.lit("getUser_by a ID2, für"))) == ["get", "user", "by", "id2"]
    assert one(spark, T.code_tokens(F.lit(None).cast("string"))) == []


def test_recency(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    assert one(spark, T.recency(F.lit(None).cast("timestamp"), now)) == 0.5
    assert one(spark, T.recency(F.lit("2025-01-01").cast("timestamp"), now)) == 1.0
    assert math.isclose(one(spark, T.recency(F.lit("2024-01-02").cast("timestamp"), now)), 0.5)


def test_rounding_of_negatives(spark):
    assert one(spark, T.round_half_up(F.lit(-0.125), 2)) == -0.12


@pytest.mark.parametrize("given_, asked, ok", [("*", "a:b", True), ("read:*", "read:x", True), ("read:file:src/*", "read:file:src/a", True), ("read:file:src/*", "read:file", False), ("read", "read:x", False), ("a", "a", True), ("write:file", "write:file:b", True)])
def test_permissions(spark, given_, asked, ok):
    assert one(spark, T.permission_matches(F.lit(given_), F.lit(asked))) is ok


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query string")


def test_bm25_edges(spark):
    d = docs(spark, "alpha beta gamma", "beta delta epsilon", "")
    found = {(r.query_id, r.doc_id): r.score for r in search.bm25(d, queries(spark, "alpha", "alpha alpha", "", "a b", "zzz")).collect()}
    assert set(found) == {(1, 1), (2, 1)}
    assert math.isclose(found[2, 1], 2 * found[1, 1], abs_tol=2e-6)
    s = search.corpus_stats(search.lengths(d)).first()
    assert (s.n, s.avgdl) == (3, 2.0)


def test_hybrid_ends(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], "query_id int, doc_id long, score double")
    k = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0)], "query_id int, doc_id long, score double")
    order = lambda a: [r.doc_id for r in search.hybrid(s, k, alpha=a).orderBy("rank").collect()]
    assert order(1.0) == [1, 2, 3] and order(0.0) == [2, 3, 1]
    zero = k.withColumn("score", F.lit(0.0))
    assert {r.keyword for r in search.hybrid(s, zero).collect()} == {0.0}


def test_rrf(spark):
    s = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc_id long, rank int")
    k = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id int, doc_id long, rank int")
    out = search.rrf(s, k).orderBy("rank").collect()
    assert len(out) == 3 and 2 in {r.doc_id for r in out[:2]}


def test_fuzzy_exact_first(spark):
    names = ["getUserById", "getUserByName", "setUser", "fetchData", "parseJSON", "UserService"]
    sym = spark.createDataFrame([(n, "function") for n in names], "name string, type string")
    assert search.fuzzy(sym, queries(spark, "getUserById")).orderBy("rank").first().name == "getUserById"
    assert search.fuzzy(sym, queries(spark, "")).count() == 0


@pytest.mark.parametrize("factors, score", [((0.8, 0.6, 0.5, True, False), 0.67), ((0.9, 0, 0, False, False), 0.45), ((0, 0, 0, False, False), 0.0)])
def test_ranker(spark, factors, score):
    assert math.isclose(one(spark, search.rank_score(*[F.lit(x) if isinstance(x, bool) else F.lit(float(x)) for x in factors])), score)


def test_zero_weights():
    assert search.weights(**dict.fromkeys(search.WEIGHTS, 0.0)) == search.WEIGHTS


def test_percentiles(spark):
    r = spark.range(1, 101).select(F.col("id").cast("double").alias("v")).agg(*evaluation.nearest_rank("v", 50, 95, 99)).first()
    assert tuple(r) == (50, 95, 99)
    r = spark.range(1, 101).select(F.col("id").cast("double").alias("v")).agg(*evaluation.floor_index("v", 50, 90, 95, 99)).first()
    assert tuple(r) == (51, 91, 96, 100)


def test_ir_goldens(spark):
    runs = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcde", 1)], "query_id int, doc_id string, rank int")
    m = evaluation.ir_metrics(runs, spark.createDataFrame([(1, x) for x in "ace"], "query_id int, doc_id string")).first()
    assert (m.p1, round(m.p3, 3), m.p5, m.recall, m.rr) == (1.0, 0.667, 0.6, 1.0, 1.0)
    none = evaluation.ir_metrics(runs, spark.createDataFrame([], "query_id int, doc_id string")).first()
    assert (none.recall, none.rr, none.ap, none.ndcg) == (0, 0, 0, 0)


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 6)] + [("b", float(x)) for x in range(100, 105)], "g string, value double")
    m = evaluation.mann_whitney(df, "g", "a", "b").first()
    assert m.u == 0 and m.p < 0.05 and abs(m.d) > 0.8
    same = spark.createDataFrame([(g, float(x)) for g in "ab" for x in range(5)], "g string, value double")
    m = evaluation.mann_whitney(same, "g", "a", "b").first()
    assert m.d == 0 and m.p > 0.9
    ties = spark.createDataFrame([("a", 1.0), ("b", 1.0)] * 3, "g string, value double")
    assert {r["rank"] for r in evaluation.average_ranks(ties).collect()} == {3.5}


def test_bootstrap_holds_mean(spark):
    r = evaluation.bootstrap(spark.range(1, 11).select("id", F.col("id").cast("double").alias("v")), "v", "id", 200).first()
    assert r.lo <= 5.5 <= r.hi and r["mean"] == 5.5


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_graphs(spark):
    e = edges(spark, ("main", "utils"), ("utils", "helpers"), ("a", "b"), ("b", "a"), ("x", "x"))
    start = spark.createDataFrame([("main",)], "node string")
    assert {(r.node, r.depth) for r in graph.closure(e, start).collect()} == {("main", 0), ("utils", 1), ("helpers", 2)}
    assert [r.path for r in graph.cycles(e).collect()] == [["a", "b", "a"]]
    assert {r.node for r in graph.roots(e).collect()} == {"main"} and {r.node for r in graph.leaves(e).collect()} == {"helpers"}
    assert graph.in_cycle(e, "helpers", "main") and not graph.in_cycle(e, "main", "helpers")


def test_three_node_cycle(spark):
    assert [r.path for r in graph.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))).collect()] == [["a", "b", "c", "a"]]


def test_tree_drops_orphans_and_cascades(spark):
    t = spark.createDataFrame([("r", None), ("c", "r"), ("g", "c"), ("h", "g"), ("o", "gone")], "id string, parent_id string")
    assert {(r.id, r.depth) for r in graph.tree(t).collect()} == {("r", 0), ("c", 1), ("g", 2), ("h", 3)}
    left = graph.cascade_delete(t, spark.createDataFrame([("c",)], "id string"))
    assert {r.id for r in left.collect()} == {"r", "o"}


def test_manifest_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "9")], "relative_path string, hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "3")], "relative_path string, hash string")
    assert dict(incremental.manifest_diff(now, was).collect()) == {"a": "unchanged", "b": "changed", "n": "new", "d": "deleted"}


def test_compliance(spark):
    cat = spark.createDataFrame([("A", "a", "x", ["t"], 2), ("B", "b", "x", ["u"], 1), ("C", "c", "x", [], 1), ("D", "d", "x", ["u"], 1)], "control string, name string, category string, evidence array<string>, least int")
    audit = spark.createDataFrame([("t", 1), ("t", 2)], "type string, ts long")
    done = security.assess(cat, audit, spark.createDataFrame([("D", "compliant")], "control string, status string"))
    assert {r.control: r.status for r in done.collect()} == {"A": "compliant", "B": "non-compliant", "C": "not-tested", "D": "compliant"}
    assert security.compliance_score(done).first().score == 66.67


def test_policies_deny(spark):
    frame = spark.createDataFrame
    args = (frame([("u", "r1"), ("u", "r1"), ("u", "r2")], "user string, role string"), frame([("r1", "base")], "role string, parent string"), frame([("base", "read:*"), ("r2", "read:x")], "role string, permission string"), frame([("r1", "p", False)], "role string, policy string, passes boolean"), frame([("u", "read:x"), ("u", "no:x")], "user string, request string"))
    got = {r.request: (r.matched, r.granted, r.explained) for r in security.decisions(*args).collect()}
    assert got == {"read:x": (True, True, False), "no:x": (False, False, False)}


def test_chunk_edges(spark):
    f = spark.createDataFrame([("a", "1\n2\n3"), ("b", ""), ("c", " \n ")], "relative_path string, content string")
    assert [tuple(r)[:3] for r in chunk.line_chunks(f, 10, 7).collect()] == [("a", 1, 3)]


@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=30), st.integers(1, 20), st.floats(0, 0.9))
@settings(max_examples=50, deadline=None)
def test_packing_covers_every_line(lines, most, overlap):
    parts = chunk.split_lines(lines, most, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(lines)
    assert all(s < e for s, e in parts)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(parts, parts[1:], strict=False))


def test_extract_symbols(spark):
    f = spark.createDataFrame([("m.py", "import os\nclass K:\n    def f(self):\n        g()\n", "python"), ("a.ts", "export function run() {}", "typescript"), ("b.zz", "function x() {}", "other")], "relative_path string, content string, language string")
    defs, sites = registries.references(f)
    assert {(r.relative_path, r.type, r.fqn) for r in defs.collect()} == {("m.py", "method", "K.f"), ("a.ts", "function", "run")}
    assert xref.indented_imports(f.where("language = 'python'")).first().module == "os"


def test_crawl(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/c.ts").write_text("let y\n")
    got = files.crawl(spark, str(tmp_path), ["skip/", "# c"]).collect()
    assert [(r.relative_path, r.language, r.content) for r in got] == [("src/a.py", "python", "x = 1\n")]


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    files.append_audit(spark.createDataFrame([(1, "a"), (2, "b")], "id long, type string"), path, 1)
    with open(f"{path}/bad.json", "w") as f:
        f.write("{not json\n")
    assert files.read_audit(spark, path, "id long, type string").count() == 2
