"""Queries over the source view and stored tables: docstrings, parse cache, symbol resolution, query generation, vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk, evaluation, registries, security, xref
from ..sources import tables as S
from ..sources.versions import Versions
from .graphs import _CODE_DEFS, _CONTROLS
from .registry import query


@query("ck08b_docstrings", "SELECT relative_path, a AS name, CAST(l + 2 AS INT) AS line, concat('// ', a, '() { in a comment') AS doc FROM v_groups WHERE g % 4 <> 3")
def ck08b(spark, d):
    return xref.docstrings(S.sources(spark, d))


@query("ck09b_parsed_once", f"WITH {_CODE_DEFS} SELECT relative_path, count(*) AS definitions, CAST(sum(len(calls)) AS BIGINT) AS calls FROM cd GROUP BY relative_path")
def ck09b(spark, d):
    """Documents of one text are read once, and have their definitions each."""
    defs, _ = xref.parsed_once(S.sources(spark, d))
    return defs.groupBy("relative_path").agg(F.count(F.lit(1)).alias("definitions"), F.sum(F.size("calls")).alias("calls"))


@query("jn13b_chunks_definitions", f"""WITH {_CODE_DEFS}, n AS (SELECT relative_path, max(l + CASE WHEN g % 4 = 3 THEN 8 ELSE 6 END) AS lines FROM v_groups GROUP BY relative_path), c AS (SELECT relative_path, unnest(range(0, CAST(lines AS BIGINT), 12)) + 1 AS start_line FROM n)
SELECT c.relative_path, CAST(c.start_line AS INT) AS start_line, name, array_to_string(calls, ',') AS calls FROM c LEFT JOIN cd ON cd.relative_path = c.relative_path AND cd.start_line = c.start_line""")
def jn13b(spark, d):
    """Chunks of twelve lines with what is defined on their first line, by an equal join on path and line."""
    files = S.sources(spark, d)
    defs, _ = xref.references(files)
    own = defs.select("relative_path", "start_line", "name", F.array_join("calls", ",").alias("calls"))
    return chunk.line_chunks(files, 12, 12).select("relative_path", "start_line").join(own, ["relative_path", "start_line"], "left")


# Names as a user types them: qualified, bare, in other case, and unknown.
_ASKED = "SELECT DISTINCT CASE g % 4 WHEN 0 THEN a WHEN 1 THEN upper(a) WHEN 2 THEN concat('no.', a) ELSE concat(a, '.', b) END AS query FROM v_groups WHERE g < 8"


@query("gr13b_resolved_symbols", f"""WITH {_CODE_DEFS}, q AS ({_ASKED}), d AS (SELECT DISTINCT relative_path, name, fqn FROM cd), k AS (SELECT query, regexp_extract(query, '[^.]*$') AS last FROM q),
 m AS (SELECT query, 0 AS lv, fqn, relative_path FROM k JOIN d ON fqn = query UNION ALL SELECT query, 1, fqn, relative_path FROM k JOIN d ON name = last UNION ALL SELECT query, 2, fqn, relative_path FROM k JOIN d ON lower(name) = lower(last))
SELECT query, ['qualified', 'name', 'any case'][lv + 1] AS level, fqn, relative_path FROM m WHERE lv = (SELECT min(lv) FROM m o WHERE o.query = m.query)""")
def gr13b(spark, d):
    files = S.sources(spark, d)
    defs, _ = xref.references(files)
    words = S.table(spark, d, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w")).where("size(w) >= 6")
    g = words.select("w", F.explode(F.sequence(F.lit(0), F.least(F.lit(7), F.floor(F.size("w") / 6).cast("int") - 1))).alias("g"))
    of = lambda k: F.concat(F.element_at("w", (F.col("g") * 6 + k + 1).cast("int")), F.lit("_"))
    kind = F.col("g") % 4
    asked = F.when(kind == 0, of(0)).when(kind == 1, F.upper(of(0))).when(kind == 2, F.concat(F.lit("no."), of(0))).otherwise(F.concat_ws(".", of(0), of(1)))
    return xref.resolved(g.select(asked.alias("query")), defs)


@query("tx13b_generated_queries", f"WITH {_CODE_DEFS}, f AS (SELECT relative_path, type, arg_min(name, start_line) AS name FROM cd GROUP BY relative_path, type) SELECT relative_path, CASE type WHEN 'function' THEN concat('where is ', name, ' defined') WHEN 'method' THEN concat('what does ', name, ' do') ELSE concat('who calls ', name) END AS query FROM f")
def tx13b(spark, d):
    """For each file a question about the first function, method and arrow function in it."""
    defs, _ = xref.references(S.sources(spark, d))
    first = defs.groupBy("relative_path", "type").agg(F.min_by("name", "start_line").alias("name"))
    ask = F.when(F.col("type") == "function", F.concat(F.lit("where is "), "name", F.lit(" defined"))).when(F.col("type") == "method", F.concat(F.lit("what does "), "name", F.lit(" do"))).otherwise(F.concat(F.lit("who calls "), "name"))
    return first.select("relative_path", ask.alias("query"))


@query("src10b_vector_table", "SELECT vec_id, label, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE label <> 3 AND vec_id % 10 <> 7 UNION ALL SELECT vec_id, -1, len(embedding), round(2 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) FROM embeddings WHERE vec_id % 10 = 7 AND vec_id % 20 <> 7")
def src10b(spark, d):
    """A vector table that is made, gets rows replaced by id, loses those of a label and some ids, and is opened again."""
    v = S.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    made = Versions(spark, buckets=4)
    made.publish({"vectors": v}, {"vectors": "vec_id"})
    made.replace(v.where("vec_id % 10 = 7").select(F.col("vec_id").alias("key")), {"vectors": v.where("vec_id % 10 = 7").select("vec_id", F.lit(-1).alias("label"), F.transform("vector", lambda x: x * 2).alias("vector"))})
    opened = Versions(spark, made.root, buckets=4)
    opened.replace(opened.table("vectors").where("label = 3 or vec_id % 20 = 7").select(F.col("vec_id").alias("key")), {"vectors": v.limit(0)})
    out = Versions(spark, made.root, buckets=4).table("vectors")
    return out.select("vec_id", "label", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("ir06b_dependency_completeness", "WITH a AS (SELECT DISTINCT src, dst FROM v_dag WHERE NOT (src LIKE 'C%' AND CAST(substr(src, 2) AS INT) % 8 = 0)), e AS (SELECT DISTINCT src, dst FROM v_dag), er AS (SELECT DISTINCT src AS n FROM e WHERE src NOT IN (SELECT dst FROM e)), el AS (SELECT DISTINCT dst AS n FROM e WHERE dst NOT IN (SELECT src FROM e)), x AS (SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM a) AS actual, (SELECT count(*) FROM er WHERE n IN (SELECT src FROM a) AND n NOT IN (SELECT dst FROM a)) / (SELECT count(*) FROM er) AS roots, (SELECT count(*) FROM el WHERE n IN (SELECT dst FROM a) AND n NOT IN (SELECT src FROM a)) / (SELECT count(*) FROM el) AS leaves) SELECT *, least(1.0, actual / expected) AS completeness, least(1.0, actual / expected) >= 0.8 AND roots >= 0.7 AND leaves >= 0.7 AS passed FROM x")
def ir06b(spark, d):
    e = S.dag(spark, d)
    return evaluation.dependency_completeness(e, e.where(~(F.col("src").startswith("C") & (F.expr("try_cast(substring(src, 2) as int)") % 8 == 0))))


@query("wn11_progress", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS iteration, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders")
def wn11(spark, d):
    return evaluation.progress(S.table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "iteration", "total")


@query("sec07b_evidence_by_category", f"WITH {_CONTROLS} SELECT category, count(DISTINCT control) AS controls, count(event_id) AS evidence, count(DISTINCT user_id) AS users FROM (SELECT control, category, unnest(evidence) AS type FROM ctl) c LEFT JOIN v_audit USING (type) GROUP BY category")
def sec07b(spark, d):
    """The catalogue's categories with the trail's evidence for their controls."""
    c = security.controls(spark).select("control", "category", F.explode("evidence").alias("type"))
    out = c.join(S.audit(spark, d), "type", "left").groupBy("category")
    return out.agg(F.countDistinct("control").alias("controls"), F.count("event_id").alias("evidence"), F.countDistinct("user_id").alias("users"))


_BY_INDENT = """id AS (SELECT replace(relative_path, '.ts', '.py') AS relative_path, g, 8 * g AS l, a, b, c, d, e, f FROM v_groups),
 pd AS (SELECT relative_path, a AS name, 'function' AS type, l + 3 AS start_line, l + 7 AS end_line, a AS fqn, list_sort(list_distinct([c, e])) AS calls FROM id WHERE g % 4 <> 3
 UNION ALL SELECT relative_path, b, 'method', l + 3, l + 7, concat(a, '.', b), list_sort(list_distinct([d, e, 'Builder'])) FROM id WHERE g % 4 = 3 UNION ALL SELECT relative_path, c, CASE WHEN b IN (SELECT o.a FROM id o WHERE o.relative_path = id.relative_path AND o.g % 4 = 3) THEN 'method' ELSE 'function' END, l + 4, l + 5, concat(a, '.', b, '.', c), [d] FROM id WHERE g % 4 = 3)"""


@query("ck05_extract_symbols", f"WITH {_CODE_DEFS}, {_BY_INDENT} SELECT relative_path, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM cd UNION ALL SELECT relative_path, name, CAST(start_line AS INT), CAST(end_line AS INT) FROM pd")
def ck05(spark, d):
    """Files of two languages, each read by the strategy that is registered for it."""
    defs, _ = registries.references(S.sources(spark, d).unionByName(S.sources(spark, d, indented=True)))
    return defs.select("relative_path", "name", "start_line", "end_line")


@query("ck06_script_symbols", f"WITH {_CODE_DEFS} SELECT type, name, count(*) AS n, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines FROM cd GROUP BY type, name")
def ck06(spark, d):
    defs, _ = xref.references(S.sources(spark, d))
    return defs.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


@query("ck07_indented_symbols", f"WITH {_BY_INDENT} SELECT relative_path, type, fqn, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, array_to_string(calls, ',') AS calls FROM pd")
def ck07(spark, d):
    defs, _ = xref.indented_references(S.sources(spark, d, indented=True))
    return defs.select("relative_path", "type", "fqn", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


@query("ck07b_indented_imports", f"WITH {_BY_INDENT} SELECT relative_path, concat('.', b) AS module, CAST(l + 2 AS INT) AS line FROM id WHERE g % 4 <> 3")
def ck07b(spark, d):
    return xref.indented_imports(S.sources(spark, d, indented=True))


@query("src22_synthetic_files", "SELECT relative_path, max(g) + 1 AS groups, CAST(sum(CASE WHEN g % 4 = 3 THEN 8 ELSE 6 END) AS BIGINT) AS lines, CAST(sum(CASE WHEN g % 4 = 3 THEN 87 + length(a) + length(b) + length(c) + length(d) + length(e) + length(f) ELSE 101 + 2 * length(a) + 2 * length(b) + length(c) + length(d) + 2 * length(e) + length(f) END) + max(g) AS BIGINT) AS chars FROM v_groups GROUP BY relative_path")
def src22(spark, d):
    """Source files made from templates and the documents' words."""
    f = S.sources(spark, d).where("content <> ''")
    groups = F.regexp_count("content", F.lit(r"(?m)^(?:class|export function) "))
    return f.select("relative_path", groups.cast("long").alias("groups"), F.size(F.split("content", "\n")).cast("long").alias("lines"), F.length("content").cast("long").alias("chars"))
