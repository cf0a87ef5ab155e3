"""Queries do the whole job: each against its SQL without the cut that the SQL of round 1 still has."""

import glob
import os

import duckdb
import pytest

from skarn.operators import graph, security
from skarn.plans import ORACLES, QUERIES

from .test_oracles import DIR, duck  # noqa: F401

ALL_QUERIES = {" WHERE item_id < 10": "", "ON q.vec_id < 10": "ON true"}
SEARCHES = ["tx01_bm25", "jn01_terms_postings", "tx04_hybrid_linear", "tx05_hybrid_rrf", "jn03_fusion_join", "st01_union_ids", "jn11_attach_rows", "tx06_ranker", "tx07_search_hybrid", "tx08_search_modes", "vx01_knn", "vx02_knn_filtered", "jn21_query_by_vectors"]


def split(names, data):
    """The rows in order, as their keys (all but floats) and their floats."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    each = sorted(([str(r[i]) for i in order if not isinstance(r[i], float)], [r[i] for i in order if isinstance(r[i], float)]) for r in data)
    return [k for k, _ in each], [v for _, v in each]


def check(spark, duck, name, cuts, where=DIR):  # noqa: F811
    sql = ORACLES[name]
    for cut, whole in cuts.items():
        sql = sql.replace(cut, whole)
    df, rel = QUERIES[name](spark, where), duck.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    (keys, got), (same, want) = split(df.columns, df.collect()), split(rel.columns, rel.fetchall())
    assert keys == same
    # A score on the half of its last digit rounds up in one engine and down in the other.
    assert all(x == pytest.approx(y, abs=1.1e-5 if name.startswith("j") else 1.1e-6) for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("name", SEARCHES)
def test_every_item_and_vector_is_a_query(spark, duck, name):  # noqa: F811
    check(spark, duck, name, ALL_QUERIES)


def test_a_new_version_adds_every_file(spark, duck):  # noqa: F811
    check(spark, duck, "inc06_version_gate", {" WHERE doc_id % 2 = 0": ""})


def test_all_postings_get_lengths(spark, duck):  # noqa: F811
    check(spark, duck, "jn02_postings_lengths", {" WHERE tf > 3": ""})


@pytest.mark.parametrize("name", ["ir01_precision_at_k", "ir02_recall_mrr_ap", "ir03_ndcg", "ir04_aggregate", "wn07_first_relevant", "jn18_retrieved_relevant"])
def test_metrics_see_the_whole_ranking(spark, name):
    # On the smallest tables no group has over 40 documents.
    larger = DIR.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in glob.glob(f"{larger}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    check(spark, con, name, {"(SELECT * FROM runs WHERE rank <= 40) r": "runs r"}, larger)


def test_a_gap_is_no_descendant(spark, tmp_path):
    turns = [(0, 0), (0, 1), (0, 3), (1, 0), (3, 0), (3, 1), (3, 2), (3, 3)]
    spark.createDataFrame([(c, t, "user", "x") for c, t in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = QUERIES["gr07_cascade_delete"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in left) == ["0-0", "0-1", "0-3", "1-0", "3-0", "3-1"]


def test_no_depth_is_too_deep(spark):
    n = 53
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)], "src string, dst string")
    start = spark.createDataFrame([("000",)], "node string")
    assert graph.closure(chain, start, 9).count() == 10
    assert graph.in_cycle(chain, f"{n:03}", "000")
    assert graph.shortest_paths(chain, "000").count() == n + 1
    inherits = chain.select(chain.src.alias("role"), chain.dst.alias("parent"))
    assert security.role_closure(inherits, spark.createDataFrame([("000",)], "role string")).count() == n + 1
    tasks = chain.select(chain.dst.alias("id"), chain.src.alias("parent_id"))
    tasks = tasks.unionByName(spark.createDataFrame([("000", None)], "id string, parent_id string"))
    assert graph.cascade_delete(tasks, start.withColumnRenamed("node", "id")).count() == 0


def test_a_tree_is_whole_and_ends(spark):
    n = 103
    rows = [("000", None), *((f"{i + 1:03}", f"{i:03}") for i in range(n)), ("000", "005")]
    found = graph.tree(spark.createDataFrame(rows, "id string, parent_id string")).collect()
    assert sorted((r.id, r.depth) for r in found) == [(f"{i:03}", i) for i in range(n + 1)]
