"""Queries of scans, filters, aggregates, windows, limits and evaluation over records (SRC, FLT, AG, WN, TK, ST, SM, SA, IR, AGT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import evaluation as E
from ..sources import files as FS
from ..sources import tables as S
from ..sources.shared import scratch
from ..streaming import state
from .registry import query


def events(spark, d):
    return S.table(spark, d, "events")


# ---- sources and sinks


@query("src01_crawl", "SELECT relative_path, language, hash, size FROM v_files WHERE regexp_matches(relative_path, '\\.(en|de)$')")
def src01(spark, d):
    return S.files(spark, d).where(F.col("relative_path").rlike(r"\.(en|de)$")).select("relative_path", "language", "hash", "size")


@query("src02_ignore_rules", "SELECT relative_path FROM v_files WHERE NOT regexp_matches(relative_path, '(^|/)src3(/|$)') AND NOT regexp_matches(relative_path, '(^|/)[^/]*\\.fr(/|$)')")
def src02(spark, d):
    return S.files(spark, d).where(~FS.ignored(F.col("relative_path"), ["# comment", "src3/", "*.fr", ""])).select("relative_path")


@query("src03_language_lookup", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'go' END AS language FROM pages")
def src03(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".TS", ".rs", ".go", ".xyz")]), (F.col("page_id") % 5 + 1).cast("int"))
    return S.table(spark, d, "pages").select("page_id", FS.language_of(ext).alias("language"))


@query("src04_recent_files", "SELECT path, CAST(last AS VARCHAR) AS last, commits, authors FROM (SELECT event_type AS path, max(ts) AS last, count(*) AS commits, count(DISTINCT user_id) AS authors FROM events GROUP BY event_type) x ORDER BY last DESC, path LIMIT 3")
def src04(spark, d):
    per = events(spark, d).groupBy(F.col("event_type").alias("path")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("commits"), F.countDistinct("user_id").alias("authors"))
    return per.orderBy(F.desc("last"), "path").limit(3).select("path", F.col("last").cast("string").alias("last"), "commits", "authors")


@query("src05_modified_since", "SELECT DISTINCT user_id AS path FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def src05(spark, d):
    return events(spark, d).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select(F.col("user_id").alias("path")).distinct()


@query("src09_round_trip", "SELECT doc_id, n_chars FROM documents")
def src09(spark, d):
    from ..sources.shared import written

    return written(S.table(spark, d, "documents").select("doc_id", "n_chars"), "round-trip")


@query("src10_vector_table", "SELECT vec_id, label FROM embeddings")
def src10(spark, d):
    from ..sources.shared import written

    return written(S.table(spark, d, "embeddings"), "vectors").select("vec_id", "label")


@query("src11_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings")
def src11(spark, d):
    from ..operators.vector import upsert

    e = S.table(spark, d, "embeddings").select("vec_id", "label")
    return upsert(e, e.where("vec_id % 10 = 0").select("vec_id", F.lit(99).alias("label")), "vec_id")


@query("src12_delete_by_path", "SELECT doc_id FROM v_files WHERE NOT starts_with(relative_path, 'src1/')")
def src12(spark, d):
    return S.files(spark, d).where(~F.col("relative_path").startswith("src1/")).select("doc_id")


@query("src13_counts", "SELECT count(*) AS n FROM embeddings")
def src13(spark, d):
    return S.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))


@query("src16_audit_log", "SELECT event_id, type FROM v_audit")
def src16(spark, d):
    return FS.audit_round_trip(S.audit(spark, d).select("event_id", "type"), "event_id long, type string")


# Audit lines in order; those of errors are cut short, so that they are no JSON.
_LINES = "ln AS (SELECT event_id, type, CASE WHEN type = 'error' THEN left(l, length(l) - 3) ELSE l END AS line FROM (SELECT event_id, type, concat('{\"event_id\":', event_id, ',\"type\":\"', type, '\",\"user_id\":', user_id, '}') AS l FROM v_audit) x)"


def _lines(spark, d):
    line = F.to_json(F.struct("event_id", "type", "user_id"))
    return S.audit(spark, d).withColumn("line", line).select("event_id", F.when(F.col("type") == "error", F.expr("left(line, length(line) - 3)")).otherwise(F.col("line")).alias("line"))


@query("src16b_rotated_log", f"WITH {_LINES} SELECT event_id, lpad(CAST(CAST(floor(before / 4096) AS BIGINT) AS VARCHAR), 12, '0') AS file FROM (SELECT event_id, type, coalesce(sum(length(line) + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ln) x WHERE type <> 'error'")
def src16b(spark, d):
    """Two runs append to a log whose files hold 4 KB; read back, lines that are no JSON are skipped."""
    lines, path = _lines(spark, d), scratch(spark, "audit-log")
    half = lines.agg(F.max("event_id")).first()[0] // 2
    FS.append_rotated(lines.where(F.col("event_id") <= half), path, "event_id", most=4096)
    FS.append_rotated(lines.where(F.col("event_id") > half), path, "event_id", most=4096)
    return FS.read_rotated(spark, path, "event_id long, type string, user_id long").select("event_id", "file")


@query("src17b_csv_of_all_keys", """WITH r AS (SELECT event_id, type, user_id, props, row_number() OVER (ORDER BY event_id) AS n FROM v_audit)
SELECT 0 AS line_no, 'event_id,note,props,type,user_id' AS line UNION ALL SELECT n, concat(event_id, ',', CASE WHEN type = 'error' THEN '"bad, ""very"" bad"' ELSE '' END, ',', CASE WHEN type = 'user_action' THEN concat('"', replace(replace(props, ' ', ''), '"', '""'), '"') ELSE '' END, ',', type, ',', CASE WHEN type <> 'error' THEN CAST(user_id AS VARCHAR) ELSE '' END) FROM r""")
def src17b(spark, d):
    """Records with other keys each: users only where there is no error, notes only where there is one, details as objects."""
    details = F.from_json("props", "struct<k:int>")
    rec = F.struct("event_id", "type", F.when(F.col("type") != "error", F.col("user_id")).alias("user_id"), F.when(F.col("type") == "error", 'bad, "very" bad').alias("note"), F.when(F.col("type") == "user_action", details).alias("props"))
    return FS.csv_export(S.audit(spark, d).select("event_id", F.to_json(rec).alias("json")), "event_id")


@query("src19b_truth_parts", "SELECT 'symbols' AS part, CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'easy' ELSE 'medium' END AS difficulty FROM labels UNION ALL SELECT 'imports', CAST(item_id AS VARCHAR), 'medium' FROM benchmark")
def src19b(spark, d):
    """Two of the five parts are written, one of them with gaps that the loader's defaults fill."""
    path = scratch(spark, "truth")
    own = S.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "easy").alias("difficulty"))
    FS.save_truth({"symbols": own, "imports": S.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"))}, path)
    parts = FS.load_truth(spark, path, {p: "id string, difficulty string" for p in FS.TRUTH_PARTS}, {"difficulty": "medium"})
    rows = [df.select(F.lit(p).alias("part"), "id", "difficulty") for p, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# A tree of files made of documents: names give the language, two folders are ignored, and one extension is none.
_TREE = "tr AS (SELECT concat(CASE doc_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN concat(source, '/dist/') ELSE concat(source, '/lib', doc_id % 3, '/') END, 'f', doc_id, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.go' ELSE '.txt' END) AS relative_path, doc_id, text FROM documents)"


@query("src01b_crawled_tree", f"WITH {_TREE} SELECT relative_path, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language, substr(sha256(text), 1, 16) AS hash, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM tr WHERE doc_id % 4 <> 3 AND NOT starts_with(relative_path, 'node_modules/') AND NOT contains(relative_path, '/dist/')")
def src01b(spark, d):
    """The documents as a tree of files in the shared folder, crawled by the data source."""
    root = scratch(spark, "tree")
    name = F.expr("concat(CASE doc_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN concat(source, '/dist/') ELSE concat(source, '/lib', doc_id % 3, '/') END, 'f', doc_id, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.go' ELSE '.txt' END)")
    tree = FS.write_tree(S.table(spark, d, "documents").select(name.alias("relative_path"), F.col("text").alias("content")), root)
    tree.write.format("noop").mode("overwrite").save()
    got = FS.crawled(spark, root, ["node_modules/", "# a comment", "dist/"], parts=8)
    return got.select("relative_path", "language", "hash", "size", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("src17_csv_export", """SELECT concat(event_id, ',', type, ',', CASE WHEN regexp_matches(props, '[,"\n]') THEN concat('"', replace(props, '"', '""'), '"') ELSE coalesce(props, '') END) AS line FROM v_audit""")
def src17(spark, d):
    return FS.csv_lines(S.audit(spark, d).select("event_id", "type", "props"))


@query("src18_csv_tokens", "SELECT concat(doc_id, ',', CAST(ceil(length(text) / 4.0) AS BIGINT)) AS line FROM documents")
def src18(spark, d):
    return FS.csv_lines(S.table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))


@query("src19_truth_loader", "SELECT doc_id, relevant, 'medium' AS difficulty FROM v_truth")
def src19(spark, d):
    return S.truth(spark, d).withColumn("difficulty", F.coalesce(F.lit(None).cast("string"), F.lit("medium")))


@query("src20_truth_writer", "SELECT doc_id, relevant FROM v_truth")
def src20(spark, d):
    return FS.audit_round_trip(S.truth(spark, d), "doc_id long, relevant int")


# ---- filters


@query("flt01_equality", "SELECT doc_id FROM documents WHERE lang = 'en'")
def flt01(spark, d):
    return S.table(spark, d, "documents").where("lang = 'en'").select("doc_id")


@query("flt02_scope", f"SELECT page_id FROM pages WHERE regexp_matches(url, '{T.glob_regex('https://**')}') AND NOT regexp_matches(url, '{T.glob_regex('**/de/**')}')")
def flt02(spark, d):
    return S.table(spark, d, "pages").where(T.in_scope(F.col("url"), ["https://**"], ["**/de/**"])).select("page_id")


@query("flt03_threshold", "SELECT p_partkey FROM part WHERE 1.0 - levenshtein(p_name, 'blue rod') / CAST(greatest(length(p_name), 8) AS DOUBLE) >= 0.4")
def flt03(spark, d):
    return S.table(spark, d, "part").where(T.similarity(F.col("p_name"), F.lit("blue rod")) >= 0.4).select("p_partkey")


@query("flt04_types", "SELECT p_partkey FROM v_symbols WHERE type IN ('STANDARD', 'PROMO')")
def flt04(spark, d):
    return S.symbols(spark, d).where(F.col("type").isin("STANDARD", "PROMO")).select("p_partkey")


@query("flt05_audit_filter", "SELECT event_id FROM v_audit WHERE type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND contains(lower(concat('{\"type\":\"', type, '\",\"user\":', user_id, '}')), 'r\":1')")
def flt05(spark, d):
    when = F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    row = F.lower(F.to_json(F.struct("type", F.col("user_id").alias("user"))))
    return S.audit(spark, d).where((F.col("type") == "error") & when & F.contains(row, F.lit('r":1'))).select("event_id")


@query("flt08_tags", "SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1")
def flt08(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return S.table(spark, d, "labels").where(F.arrays_overlap(tags, F.array(F.lit("good"), F.lit("toxic")))).select("doc_id")


@query("flt09_prefix_delete", "SELECT doc_id FROM documents WHERE NOT starts_with(source, 'src1')")
def flt09(spark, d):
    return S.table(spark, d, "documents").where(~F.col("source").startswith("src1")).select("doc_id")


@query("flt15_projection", "SELECT relative_path AS file, language AS lang, 1 AS start_line FROM v_files")
def flt15(spark, d):
    return S.files(spark, d).select(F.col("relative_path").alias("file"), F.col("language").alias("lang"), F.lit(1).alias("start_line"))


# ---- aggregates


@query("ag02_by_language", "SELECT coalesce(lang, 'all') AS lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang)")
def ag02(spark, d):
    return S.table(spark, d, "documents").rollup("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "files", "chars")


_HIT = "SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY query ORDER BY ts, event_id)) < 300, false) AS hit FROM v_query_log"


@query("ag05_query_totals", f"SELECT count(*) AS total, CAST(count_if(hit) AS BIGINT) AS hits, CAST(count_if(NOT hit) AS BIGINT) AS misses, round(count_if(hit) / count(*), 9) AS hit_rate FROM ({_HIT}) x")
def ag05(spark, d):
    return A.query_totals(S.query_log(spark, d))


@query("wn04_cache_hits", f"SELECT event_id, hit FROM ({_HIT}) x")
def wn04(spark, d):
    return A.cache_hits(S.query_log(spark, d)).select("event_id", "hit")


@query("jn22_last_same_query", "SELECT event_id, lag(event_id) OVER (PARTITION BY query ORDER BY ts, event_id) AS before FROM v_query_log")
def jn22(spark, d):
    return S.query_log(spark, d).select("event_id", F.lag("event_id").over(Window.partitionBy("query").orderBy("ts", "event_id")).alias("before"))


_LAST = "SELECT * FROM v_query_log ORDER BY ts DESC, event_id DESC LIMIT 200"


@query("ag06_latency_floor_index", f"SELECT l[CAST(floor(n * 50 / 100.0) AS INT) + 1] AS p50, l[CAST(floor(n * 95 / 100.0) AS INT) + 1] AS p95, l[1] AS lo, l[n] AS hi FROM (SELECT list_sort(list(latency_ms)) AS l, CAST(count(*) AS INT) AS n FROM ({_LAST}) y) x")
def ag06(spark, d):
    last = S.query_log(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return last.agg(*E.floor_index("latency_ms", 50, 95), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))


@query("ag07_patterns", "SELECT query AS pattern, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency, round(avg(results_count), 6) AS avg_results FROM v_query_log GROUP BY query ORDER BY n DESC, pattern LIMIT 20")
def ag07(spark, d):
    return A.patterns(S.query_log(spark, d)).select("pattern", "n", F.round("avg_latency", 6).alias("avg_latency"), F.round("avg_results", 6).alias("avg_results"))


_TOKENS = "SELECT source, CAST(ceil(length(text) / 8.0) AS BIGINT) AS used, CAST(ceil(length(text) / 4.0) AS BIGINT) AS naive FROM documents"


def _tokens(spark, d):
    return S.table(spark, d, "documents").select("source", F.ceil(F.length("text") / 8).cast("long").alias("used"), T.token_estimate(F.col("text")).alias("naive"))


_SAVE = "count(*) AS queries, CAST(sum(used) AS BIGINT) AS used, CAST(sum(greatest(0, naive - used)) AS BIGINT) AS saved, round(sum(greatest(0, naive - used)) / sum(used + greatest(0, naive - used)) * 100, 6) AS percent, round(sum(greatest(0, naive - used)) / 1e6 * 3.0, 9) AS cost"


@query("ag08_token_savings", f"SELECT source, {_SAVE} FROM ({_TOKENS}) x GROUP BY source")
def ag08(spark, d):
    return A.token_savings(_tokens(spark, d), "source")


@query("ag09_token_cost", f"SELECT {_SAVE} FROM ({_TOKENS}) x")
def ag09(spark, d):
    return A.token_savings(_tokens(spark, d))


@query("ag10_memory_by_language", "SELECT lang, count(*) AS files, max(n_chars) AS peak, round(max(n_chars) / count(*), 6) AS per_file FROM documents GROUP BY lang")
def ag10(spark, d):
    return S.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.max("n_chars").alias("peak"), F.round(F.max("n_chars") / F.count(F.lit(1)), 6).alias("per_file"))


@query("ag11_peak_sample", "SELECT event_id, value FROM events ORDER BY value DESC, ts, event_id LIMIT 1")
def ag11(spark, d):
    best = F.min_by(F.struct("event_id", "value"), F.struct(-F.col("value"), F.col("ts"), F.col("event_id"))).alias("b")
    return events(spark, d).agg(best).select("b.event_id", "b.value")


@query("ag12_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, round(stddev_pop(value), 6) AS sd, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def ag12(spark, d):
    return events(spark, d).groupBy("event_type").agg(*E.nearest_rank("value", 50, 90, 99), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg("value"), 6).alias("mean"))


@query("ag13_custom_metric", "SELECT round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS sd, count(*) AS n FROM customer")
def ag13(spark, d):
    return S.table(spark, d, "customer").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("ag14_pass_rate", "SELECT round(avg(CAST(quality AS DOUBLE)), 9) AS rate FROM labels")
def ag14(spark, d):
    return S.table(spark, d, "labels").agg(F.round(F.avg(F.col("quality").cast("double")), 9).alias("rate"))


@query("ag15_suite_summary", "SELECT count(*) AS total, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS passed, round(avg(o_totalprice), 4) AS mean FROM orders")
def ag15(spark, d):
    return S.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") != "F").alias("passed"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("ag16_breakdown", "SELECT r_name AS part, count(n_nationkey) AS n FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE') r LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def ag16(spark, d):
    r = S.table(spark, d, "region")
    n = S.table(spark, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("part"))
    values = r.select(F.col("r_name").alias("part")).union(spark.range(1).select(F.lit("NOWHERE")))
    return A.breakdown(n, values, "part", F.count(F.lit(1)).alias("n"))


@query("ag17_agent_comparison", "SELECT o_orderpriority AS agent, count(*) AS runs, round(avg(CAST(o_orderstatus = 'F' AS INT)), 9) AS success, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def ag17(spark, d):
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("agent")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 9).alias("success"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("ag18_recovery_summary", "SELECT count(*) AS runs, CAST(count_if(value < 100) AS BIGINT) AS recovered, round(avg(value), 6) AS mean, max(value) AS worst, min(value) AS best FROM events WHERE event_type = 'error'")
def ag18(spark, d):
    return events(spark, d).where("event_type = 'error'").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") < 100).alias("recovered"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("worst"), F.min("value").alias("best"))


@query("ag22_evidence_summary", "SELECT type, CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'unknown' END AS severity, count(*) AS n FROM v_audit GROUP BY ALL")
def ag22(spark, d):
    severity = F.coalesce(F.when(F.col("user_id") % 3 == 0, "high"), F.lit("unknown"))
    return S.audit(spark, d).groupBy("type", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("ag24_pool_metrics", "SELECT CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS completed, CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS failed, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean FROM orders")
def ag24(spark, d):
    ok = F.col("o_orderstatus") == "F"
    return S.table(spark, d, "orders").agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("o_totalprice"))), 4).alias("mean"))


@query("ag26_directory_sizes", "SELECT split_part(relative_path, '/', 1) AS folder, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM v_files GROUP BY folder")
def ag26(spark, d):
    return S.files(spark, d).groupBy(F.substring_index("relative_path", "/", 1).alias("folder")).agg(F.sum(F.octet_length("content")).alias("bytes"))


@query("ag27_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def ag27(spark, d):
    return S.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("ag28_validator_totals", "SELECT CAST(sum(quality) AS BIGINT) AS errors, CAST(sum(toxic) AS BIGINT) AS warnings, bool_and(quality = 0) AS passed FROM labels")
def ag28(spark, d):
    return S.table(spark, d, "labels").agg(F.sum("quality").alias("errors"), F.sum("toxic").alias("warnings"), F.bool_and(F.col("quality") == 0).alias("passed"))


@query("ag29_violations", "SELECT p_partkey, 'size' AS resource, CAST(p_size AS DOUBLE) AS used FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice > 1500")
def ag29(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "resource", "used").where("(resource = 'size' and used > 40) or (resource = 'price' and used > 1500)")


@query("ag30_token_benchmark", f"SELECT source, round(avg(1 - used / CAST(naive AS DOUBLE)) * 100, 6) AS reduction FROM ({_TOKENS}) x WHERE naive > 0 GROUP BY source")
def ag30(spark, d):
    return _tokens(spark, d).where("naive > 0").groupBy("source").agg(F.round(F.avg(1 - F.col("used") / F.col("naive")) * 100, 6).alias("reduction"))


# ---- windows, limits, sets


@query("wn01_rank_positions", "SELECT vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS INT) AS place FROM embeddings")
def wn01(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))).alias("place"))


@query("wn02_tied_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def wn02(spark, d):
    return E.average_ranks(S.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("value"))).select("p_partkey", "rank")


@query("wn03_cumulative_relevant", "SELECT doc_id, CAST(sum(quality) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS BIGINT) AS cum FROM labels")
def wn03(spark, d):
    w = Window.partitionBy(F.col("doc_id") % 10).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return S.table(spark, d, "labels").select("doc_id", F.sum("quality").over(w).alias("cum"))


@query("wn05_last_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def wn05(spark, d):
    return A.last_n(events(spark, d), 100, F.desc("ts"), F.desc("event_id")).select("event_id")


@query("wn06_offered_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS load FROM events")
def wn06(spark, d):
    w = Window.partitionBy("user_id").orderBy(A.seconds("ts")).rangeBetween(-3600, 0)
    return events(spark, d).select("event_id", F.count(F.lit(1)).over(w).alias("load"))


def _limited(most, seconds):
    """Recursive: a user's calls one after the other, with the times of those that passed."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT event_id, user_id, n, true AS accepted, [t] AS held FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, len(h) < {most}, CASE WHEN len(h) < {most} THEN list_append(h, t) ELSE h END FROM (SELECT e.*, list_filter(r.held, lambda x: e.t - x < {seconds}) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) y)
SELECT event_id, accepted FROM r"""


@query("wn06b_rate_limiter", _limited(2, 3600))
def wn06b(spark, d):
    from ..streaming.state import rate_limited

    return rate_limited(events(spark, d), most=2, seconds=3600)


@query("wn10_git_priority", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 200 ELSE 100 - CAST(row_number() OVER (ORDER BY last DESC, user_id) - 1 AS INT) END AS priority FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) x")
def wn10(spark, d):
    per = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last"))
    placed = E.running(per, F.lit(1), F.desc("last"), F.col("user_id"), name="place")
    return placed.select("user_id", F.when(F.col("user_id") % 5 == 0, 200).otherwise(101 - F.col("place")).cast("int").alias("priority"))


@query("tk01_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def tk01(spark, d):
    return events(spark, d).select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query("tk02_score_then_name", "SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 25")
def tk02(spark, d):
    return S.table(spark, d, "part").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(25).select("p_partkey", "p_name")


@query("tk03_epsilon_ties", "SELECT event_id FROM (SELECT event_id, round(value / 1000, 10) AS s FROM events) x ORDER BY s DESC, event_id LIMIT 20")
def tk03(spark, d):
    return events(spark, d).select("event_id", F.round(F.col("value") / 1000, 10).alias("s")).orderBy(F.desc("s"), "event_id").limit(20).select("event_id")


@query("tk04_over_fetch", "SELECT event_id FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 60) x WHERE event_type <> 'view' ORDER BY value DESC, event_id LIMIT 10")
def tk04(spark, d):
    first = events(spark, d).orderBy(F.desc("value"), "event_id").limit(60)
    return first.where("event_type <> 'view'").orderBy(F.desc("value"), "event_id").limit(10).select("event_id")


@query("tk06_pagination", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 40")
def tk06(spark, d):
    return events(spark, d).orderBy("ts", "event_id").offset(40).limit(20).select("event_id")


@query("tk08_languages_by_size", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def tk08(spark, d):
    return S.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query("tk09_winner", "SELECT user_id, event_type AS winner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events WHERE event_type <> 'error') x WHERE rn = 1")
def tk09(spark, d):
    return events(spark, d).where("event_type <> 'error'").groupBy("user_id").agg(F.min_by("event_type", F.struct("value", "event_id")).alias("winner"))


@query("st03_intersection", "SELECT count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en') x")
def st03(spark, d):
    good = S.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return good.join(S.table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


_SETS = "SELECT lang, count_if(length(text) > 2000) AS found, count_if(quality = 1) AS expected, count_if(length(text) > 2000 AND quality = 1) AS hit FROM documents JOIN labels USING (doc_id) GROUP BY lang"


@query("st07_set_scores", f"SELECT lang, round(p, 9) AS p, round(r, 9) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM (SELECT lang, CASE WHEN found > 0 THEN hit / found WHEN expected = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN expected > 0 THEN hit / expected ELSE 1.0 END AS r FROM ({_SETS}) y) x")
def st07(spark, d):
    j = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    long, good = F.length("text") > 2000, F.col("quality") == 1
    c = j.groupBy("lang").agg(F.count_if(long).alias("found"), F.count_if(good).alias("expected"), F.count_if(long & good).alias("hit"))
    p, r, f1 = E.set_scores(F.col("found"), F.col("expected"), F.col("hit"))
    return c.select("lang", F.round(p, 9).alias("p"), F.round(r, 9).alias("r"), F.round(f1, 9).alias("f1"))


@query("ir05_symbol_accuracy", f"SELECT lang, CAST(hit AS BIGINT) AS hit, CAST(found - hit AS BIGINT) AS wrong, CAST(expected - hit AS BIGINT) AS missed FROM ({_SETS}) x")
def ir05(spark, d):
    j = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    long, good = F.length("text") > 2000, F.col("quality") == 1
    return j.groupBy("lang").agg(F.count_if(long & good).alias("hit"), F.count_if(long & ~good).alias("wrong"), F.count_if(good & ~long).alias("missed"))


# ---- stateful behaviour over a batch


@query("sm01_sessions", "SELECT user_id, CAST(sum(n) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800 THEN 0 ELSE 1 END AS n FROM events) x GROUP BY user_id")
def sm01(spark, d):
    return A.sessions(events(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("sm02_repeat_cache", f"SELECT query, CAST(count_if(NOT hit) AS BIGINT) AS misses FROM ({_HIT}) x GROUP BY query")
def sm02(spark, d):
    return A.cache_hits(S.query_log(spark, d)).groupBy("query").agg(F.count_if(~F.col("hit")).alias("misses"))


@query("sm02b_stream_repeat_cache", f"SELECT event_id, query AS key, hit FROM ({_HIT}) x")
def sm02b(spark, d):
    """The log as a stream of micro-batches; the time of each key's last query is kept between them."""
    log = state.event_time(S.query_log(spark, d))
    return state.finished(state.cache_hits(state.replayed(log, 3)), "cache-hits")


@query("sm03b_stream_rate_limiter", _limited(3, 7200))
def sm03b(spark, d):
    return state.finished(state.rate_limited_stream(state.replayed(state.event_time(events(spark, d)), 2), 3, 7200), "rate-limited")


@query("sm05_restarted_stream", "SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, user_id")
def sm05(spark, d):
    """Two micro-batches, then a driver lost after the second was written and before that was noted; the next run repeats it
    and goes on."""
    log = state.event_time(events(spark, d))
    replay, ledger = state.Replay(log, 4), state.Ledger(spark, scratch(spark, "ledger"))
    ledger.run(replay.add(2).stream())
    ledger.unnoted(1)
    ledger.run(replay.add(2).stream())
    return ledger.table(log.schema).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sm08_sliding_windows", "SELECT s AS start, event_type, count(*) AS n, max(value) AS peak FROM (SELECT event_type, value, ts, unnest([CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT), CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) - 3600]) AS s FROM events) x WHERE s + 7200 <= (SELECT epoch(max(ts)) - 600 FROM events) GROUP BY s, event_type")
def sm08(spark, d):
    """Two hours long, each hour; those that the watermark has passed."""
    w = state.finished(state.sliding(state.replayed(state.event_time(events(spark, d)), 2)), "sliding")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "peak")


@query("sm04_samples", "SELECT CAST(floor(epoch(ts) / 5) * 5 AS BIGINT) AS start, max(value) AS peak, count(*) AS n FROM events GROUP BY start ORDER BY start DESC LIMIT 100")
def sm04(spark, d):
    return A.samples(events(spark, d))


@query("sm07_operations", "WITH s AS (SELECT user_id, event_id AS op, ts AS a, (SELECT min(struct_pack(ts := e.ts, id := e.event_id)) FROM events e WHERE e.user_id = o.user_id AND e.event_type = 'purchase' AND (e.ts > o.ts OR (e.ts = o.ts AND e.event_id > o.event_id))) AS b FROM events o WHERE event_type = 'signup') SELECT s.user_id, op, max(value) AS peak, count(*) AS n FROM s JOIN events e ON e.user_id = s.user_id AND (e.ts > a OR (e.ts = a AND e.event_id >= op)) AND (e.ts < b.ts OR (e.ts = b.ts AND e.event_id <= b.id)) WHERE b IS NOT NULL GROUP BY s.user_id, op")
def sm07(spark, d):
    return A.operations(events(spark, d), "signup", "purchase")


# ---- statistics


@query("sa01_bootstrap", """WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM v), draws AS (
  SELECT round, CAST(concat('0x', substr(md5(concat(round, ':', place, ':42')), 1, 13)) AS BIGINT) % n AS place FROM v CROSS JOIN n CROSS JOIN range(1, 1001) r(round)),
  m AS (SELECT round, sum(v) / count(*) AS m FROM draws JOIN v USING (place) GROUP BY round), s AS (SELECT list(m ORDER BY m) AS l, stddev_pop(m) AS std_error FROM m)
  SELECT round((SELECT avg(v) FROM v), 6) AS mean, round(l[26], 6) AS lo, round(l[976], 6) AS hi, round(std_error, 6) AS std_error FROM s""")
def sa01(spark, d):
    return E.bootstrap(S.table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "std_error")])


_GROUPS = "r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT count_if(event_type = 'click') AS n1, count_if(event_type = 'view') AS n2, sum(rk) FILTER (event_type = 'click') AS r1, avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'view') AS m2, var_pop(value) FILTER (event_type = 'click') AS v1, var_pop(value) FILTER (event_type = 'view') AS v2 FROM r)"
_U = "SELECT *, least(n1 * n2 + n1 * (n1 + 1) / 2.0 - r1, n1 * n2 - (n1 * n2 + n1 * (n1 + 1) / 2.0 - r1)) AS u FROM s"
_D = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"


def _cdf(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    return f"(0.5 * (1.0 + sign({z}) * (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2.0))))"


@query("sa02_mann_whitney", f"WITH {_GROUPS} SELECT u, round(z, 9) AS z, round(2 * (1 - {_cdf('abs(z)')}), 9) AS p FROM (SELECT u, (u - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM ({_U}) y) x")
def sa02(spark, d):
    m = E.mann_whitney(events(spark, d), "event_type", "click", "view")
    return m.select("u", F.round("z", 9).alias("z"), F.round("p", 9).alias("p"))


@query("sa03_cohens_d", f"WITH {_GROUPS} SELECT round({_D}, 9) AS d FROM s")
def sa03(spark, d):
    return E.mann_whitney(events(spark, d), "event_type", "click", "view").select(F.round("d", 9).alias("d"))


@query("sa04_normal_cdf", f"SELECT p_partkey, round({_cdf('z')}, 9) AS cdf FROM (SELECT p_partkey, (p_size - 25.5) / 10.0 AS z FROM part) x")
def sa04(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.round(E.normal_cdf((F.col("p_size") - 25.5) / 10.0), 9).alias("cdf"))


@query("sa05_effect_labels", "SELECT p_partkey, CASE WHEN abs(e) < 0.2 THEN 'negligible' WHEN abs(e) < 0.5 THEN 'small' WHEN abs(e) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM (SELECT p_partkey, (p_size - 25) / 25.0 AS e FROM part) x")
def sa05(spark, d):
    return S.table(spark, d, "part").select("p_partkey", E.effect_label((F.col("p_size") - 25) / 25.0).alias("label"))


_ORDER = "md5(concat(doc_id, ':42'))"


@query("sa06_folds", f"SELECT doc_id, CAST(least(4, floor((row_number() OVER (ORDER BY {_ORDER}, doc_id) - 1) / floor(count(*) OVER () / 5))) AS INT) AS fold FROM labels")
def sa06(spark, d):
    return E.folds(S.table(spark, d, "labels").select("doc_id"), "doc_id", 5)


_METRICS = "SELECT event_type AS name, avg(value) AS value FROM events WHERE {} GROUP BY event_type"
_CMP = f"SELECT name, (c.value - b.value) / b.value * 100 AS change, abs((c.value - b.value) / b.value * 100) > 10 AS significant, CASE WHEN name = 'error' THEN c.value < b.value ELSE c.value > b.value END AS improved FROM ({_METRICS.format('event_id % 2 = 0')}) b JOIN ({_METRICS.format('event_id % 2 = 1')}) c USING (name)"


def _compared(spark, d):
    side = lambda k: events(spark, d).where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value")).withColumn("lower_is_better", F.col("name") == "error")
    return E.compared(side(0), side(1))


@query("sa07_assessment", f"SELECT CASE WHEN up > down THEN 'improved' WHEN down > up THEN 'regressed' ELSE 'unchanged' END AS assessment FROM (SELECT count_if(significant AND improved) AS up, count_if(significant AND NOT improved) AS down FROM ({_CMP}) y) x")
def sa07(spark, d):
    return E.assessment(_compared(spark, d))


@query("sa08_comparison", f"SELECT name, round(change, 6) AS change, improved FROM ({_CMP}) x")
def sa08(spark, d):
    return _compared(spark, d).select("name", F.round("change", 6).alias("change"), "improved")


@query("jn14_metrics_by_name", f"SELECT name, significant FROM ({_CMP}) x")
def jn14(spark, d):
    return _compared(spark, d).select("name", "significant")


_DIFF = "CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"


@query("sa09_stratified", f"SELECT doc_id, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY {_ORDER}, doc_id) AS rn FROM (SELECT doc_id, {_DIFF} AS difficulty FROM labels) y) x WHERE rn <= CASE WHEN difficulty = 'hard' THEN 8 ELSE 6 END")
def sa09(spark, d):
    return E.stratified(S.table(spark, d, "labels").select("doc_id", F.expr(_DIFF).alias("difficulty")), "doc_id", 20)


@query("sa10_seeded_shuffle", f"SELECT doc_id FROM labels ORDER BY {_ORDER}, doc_id LIMIT 15")
def sa10(spark, d):
    return S.table(spark, d, "labels").select("doc_id").orderBy(E.hash_order(F.col("doc_id"), 42), "doc_id").limit(15)


# ---- retrieval metrics: a query for each last digit, documents by length

_RUNS = "runs AS (SELECT doc_id % 10 AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents), rel AS (SELECT doc_id % 10 AS query_id, doc_id FROM v_truth WHERE relevant = 1), j AS (SELECT r.*, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM runs r LEFT JOIN rel USING (query_id, doc_id)), c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM j), n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id)"
_IR = f"{_RUNS}, m AS (SELECT query_id, " + ", ".join(f"CAST(sum(rel) FILTER (rank <= {k}) AS DOUBLE) / {k} AS p{k}" for k in E.KS) + ", CASE WHEN n_rel > 0 THEN sum(rel) / n_rel ELSE 0 END AS recall, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS rr, CASE WHEN n_rel > 0 THEN sum(CASE WHEN rel = 1 THEN cum / rank ELSE 0 END) / n_rel ELSE 0 END AS ap, CASE WHEN n_rel > 0 THEN sum(rel / log2(rank + 1)) / list_sum(list_transform(range(1, CAST(n_rel AS INT) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0 END AS ndcg FROM c LEFT JOIN n USING (query_id) GROUP BY query_id, n_rel)"


def _runs(spark, d):
    place = F.row_number().over(Window.partitionBy(F.col("doc_id") % 10).orderBy(F.desc("n_chars"), "doc_id"))
    return S.table(spark, d, "documents").select((F.col("doc_id") % 10).alias("query_id"), "doc_id", place.alias("rank"))


def _relevant(spark, d):
    return S.truth(spark, d).where("relevant = 1").select((F.col("doc_id") % 10).alias("query_id"), "doc_id")


@query("ir01_precision_at_k", f"WITH {_IR} SELECT query_id, p1, p3, p5, p10, p20 FROM m")
def ir01(spark, d):
    return E.ir_metrics(_runs(spark, d), _relevant(spark, d)).select("query_id", "p1", "p3", "p5", "p10", "p20")


@query("ir02_recall_mrr_ap", f"WITH {_IR} SELECT query_id, round(recall, 9) AS recall, round(rr, 9) AS rr, round(ap, 9) AS ap FROM m")
def ir02(spark, d):
    m = E.ir_metrics(_runs(spark, d), _relevant(spark, d))
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "rr", "ap")])


@query("ir03_ndcg", f"WITH {_IR}, g AS (SELECT doc_id % 10 AS query_id, doc_id, quality + toxic AS grade FROM labels), dg AS (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM runs r LEFT JOIN g USING (query_id, doc_id) GROUP BY query_id), ig AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM g) y GROUP BY query_id) SELECT query_id, round(ndcg, 9) AS ndcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 9) AS graded FROM m JOIN dg USING (query_id) LEFT JOIN ig USING (query_id)")
def ir03(spark, d):
    grades = S.table(spark, d, "labels").select((F.col("doc_id") % 10).alias("query_id"), "doc_id", (F.col("quality") + F.col("toxic")).alias("grade"))
    graded = E.graded_ndcg(_runs(spark, d), grades).select("query_id", F.round("ndcg", 9).alias("graded"))
    return E.ir_metrics(_runs(spark, d), _relevant(spark, d)).select("query_id", F.round("ndcg", 9).alias("ndcg")).join(graded, "query_id")


@query("ir04_aggregate", f"WITH {_IR} SELECT round(avg(p10), 9) AS precision, round(avg(recall), 9) AS recall, round(2 * avg(p10) * avg(recall) / (avg(p10) + avg(recall)), 9) AS f1, round(avg(rr), 9) AS mrr, round(avg(ap), 9) AS map FROM m")
def ir04(spark, d):
    m = E.ir_metrics(_runs(spark, d), _relevant(spark, d)).agg(F.avg("p10").alias("p"), F.avg("recall").alias("r"), F.avg("rr").alias("mrr"), F.avg("ap").alias("map"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return m.select(F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round(f1, 9).alias("f1"), F.round("mrr", 9).alias("mrr"), F.round("map", 9).alias("map"))


@query("wn07_first_relevant", f"WITH {_RUNS} SELECT query_id, min(rank) FILTER (rel = 1) AS first FROM j GROUP BY query_id")
def wn07(spark, d):
    return E.judged(_runs(spark, d), _relevant(spark, d)).groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))


@query("jn18_retrieved_relevant", f"WITH {_RUNS} SELECT query_id, doc_id, rel FROM j")
def jn18(spark, d):
    return E.judged(_runs(spark, d), _relevant(spark, d)).select("query_id", "doc_id", "rel")


@query("ir06_completeness", "SELECT least(1.0, (SELECT count(*) FROM v_edges) / 25.0) AS edges, least(1.0, 5 / 5.0) >= 0.8 AND least(1.0, (SELECT count(*) FROM v_edges) / 25.0) >= 0.7 AS passed")
def ir06(spark, d):
    n = S.edges(spark, d).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 25.0).alias("edges"), F.least(F.lit(1.0), F.countDistinct("src") / 5.0).alias("nodes"))
    return n.select("edges", ((F.col("nodes") >= 0.8) & (F.col("edges") >= 0.7)).alias("passed"))


@query("ir07_token_reduction", f"SELECT round(1 - sum(used) / sum(naive), 9) AS reduction, 1 - sum(used) / sum(naive) >= 0.5 AS passed FROM ({_TOKENS}) x")
def ir07(spark, d):
    r = 1 - F.sum("used") / F.sum("naive")
    return _tokens(spark, d).agg(F.round(r, 9).alias("reduction"), (r >= 0.5).alias("passed"))


@query("ir08_tiers", "SELECT source, CASE WHEN n > 200 THEN 'xlarge' WHEN n >= 100 THEN 'large' WHEN n >= 20 THEN 'medium' WHEN n >= 5 THEN 'small' ELSE 'tiny' END AS tier FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) x")
def ir08(spark, d):
    n = F.col("n")
    tier = F.when(n > 200, "xlarge").when(n >= 100, "large").when(n >= 20, "medium").when(n >= 5, "small").otherwise("tiny")
    return S.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", tier.alias("tier"))


# ---- agents


@query("agt01_assignment", "SELECT t.n_nationkey AS task, min(s.s_suppkey) AS agent FROM nation t LEFT JOIN supplier s ON s.s_suppkey % 3 <> 0 AND (t.n_nationkey % 2 = 0 OR s.s_nationkey % 2 = 1) GROUP BY t.n_nationkey")
def agt01(spark, d):
    tasks = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("task"), F.lit(None).cast("string").alias("role"), F.when(F.col("n_nationkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("py"))).alias("languages"))
    agents = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), F.lit("dev").alias("agent_role"), F.when(F.col("s_nationkey") % 2 == 1, F.array(F.lit("py"), F.lit("ts"))).otherwise(F.array(F.lit("ts"))).alias("agent_languages"), (F.col("s_suppkey") % 3 != 0).alias("idle"))
    return A.assign(tasks, agents)


@query("agt02_autoscale", "SELECT n_nationkey, CASE WHEN b / 10.0 * 100 > 70 AND 10 < 12 THEN 1 WHEN b / 10.0 * 100 < 35 AND 10 > 2 THEN -1 ELSE 0 END AS change FROM (SELECT n_nationkey, n_nationkey % 11 AS b FROM nation) x")
def agt02(spark, d):
    return S.table(spark, d, "nation").select("n_nationkey", A.autoscale(F.col("n_nationkey") % 11, F.lit(10), 70, 2, 12).alias("change"))


@query("agt03_review_decision", "SELECT n_nationkey, CASE WHEN e > 0 THEN 'rejected' WHEN w > 5 THEN 'escalated' ELSE 'approved' END AS normal, CASE WHEN e > 0 OR w > 2 THEN 'rejected' ELSE 'approved' END AS strict, CASE WHEN e > 2 THEN 'rejected' ELSE 'approved' END AS lenient FROM (SELECT n_nationkey, n_nationkey % 4 AS e, n_nationkey % 7 AS w FROM nation) x")
def agt03(spark, d):
    e, w = F.col("n_nationkey") % 4, F.col("n_nationkey") % 7
    return S.table(spark, d, "nation").select("n_nationkey", *[A.decision(e, w, s).alias(s) for s in ("normal", "strict", "lenient")])


@query("agt04_review_rules", "SELECT doc_id, CAST(contains(text, 'eval(') OR contains(text, 'exec(') AS INT) AS errors, CAST(length(text) > 500 AND NOT contains(text, '//') AS INT) AS warnings FROM documents")
def agt04(spark, d):
    e, w, _ = A.review(F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", e.alias("errors"), w.alias("warnings"))


@query("ext02_failure_text", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Add the missing import' WHEN 'view' THEN 'Check the types' ELSE 'Read the message' END AS hint FROM events")
def ext02(spark, d):
    text = F.when(F.col("event_type") == "error", "ModuleNotFoundError: x").when(F.col("event_type") == "view", "TypeError: y").otherwise("boom")
    hint = F.when(text.rlike("ModuleNotFound|Cannot find module"), "Add the missing import").when(text.rlike("TypeError"), "Check the types").otherwise("Read the message")
    return events(spark, d).select("event_id", hint.alias("hint"))
