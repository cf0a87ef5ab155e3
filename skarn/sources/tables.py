"""Tables and the views that stand for the engine's abstractions. Schemas come with the parquet files; views are lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files."""
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", path.alias("relative_path"), F.col("lang").alias("language"), F.col("text").alias("content"), T.short_hash(F.col("text")).alias("hash"), F.col("n_chars").alias("size"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """An earlier state of the files: some are missing, some stale, some gone since."""
    f = files(spark, d)
    old = f.where("doc_id % 10 <> 0").select("relative_path", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("hash")).alias("hash"))
    return old.unionByName(f.where("doc_id % 11 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("relative_path"), F.lit("x").alias("hash")))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("query"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("results_count"))


# What an event type stands for in the audit trail.
AUDIT_TYPES = {"click": "tool_invocation", "view": "file_change", "purchase": "user_action", "signup": "security_event"}


def audit(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AUDIT_TYPES.items() for x in kv]), F.col("event_type")), F.lit("error"))
    return table(spark, d, "events").select("event_id", "ts", "user_id", "value", "props", kind.alias("type"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A cyclic graph: which event type follows which."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(before.alias("src"), F.col("event_type").alias("dst")).where("src is not null and src <> dst").distinct()


def dag(spark: SparkSession, d: str) -> DataFrame:
    """An acyclic graph: customers and suppliers to nations to regions."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(key("N", "n_nationkey").alias("src"), key("R", "n_regionkey").alias("dst"))
    c = table(spark, d, "customer").select(key("C", "c_custkey").alias("src"), key("N", "c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(key("S", "s_suppkey").alias("src"), key("N", "s_nationkey").alias("dst"))
    return n.union(c).union(s)


# Task states by turn.
STATES = ["completed", "running", "failed", "pending"]


def tasks(spark: SparkSession, d: str) -> DataFrame:
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn = F.col("turn")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (turn % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select(key(turn).alias("id"), F.when(turn > 0, key(turn - 1)).alias("parent_id"), F.col("role").alias("label"), state.alias("status"), F.col("text"), "conv_id", "turn")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("callee"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    """A history of commits (seq, line) in the form of a name-status diff: what a user clicks is modified, a view renames the
    user's file, a purchase deletes it, a signup adds it, an error touches the user's notes."""
    n = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id"))
    at = lambda v: F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit("_"), v.cast("string"), F.lit(".ts"))
    v = F.col("v")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("R090\t"), at(v - 1), F.lit("\t"), at(v)))
        .when(F.col("event_type") == "click", F.concat(F.lit("M\t"), at(v))).when(F.col("event_type") == "purchase", F.concat(F.lit("D\t"), at(v)))
        .when(F.col("event_type") == "signup", F.concat(F.lit("A\t"), at(v))).otherwise(F.concat(F.lit("M\tdocs/u"), F.col("user_id").cast("string"), F.lit(".md")))
    )
    return table(spark, d, "events").select("event_id", "user_id", "event_type", n.alias("v")).select(F.col("event_id").alias("seq"), line.alias("line"))


# The two forms of the source view's groups of six words; {0} to {5} are names made of them.
FUNCTION_LINES = ["// {0}() {{ in a comment", "export function {0}({1}) {{", "  {2}({3}, \"{4}() {{\");", "  if ({5}) {{ this.{4}({1}); }}", "  return {{ key: `}}` }};", "}}"]
CLASS_LINES = ["class {0} {{", "  async {1}({2}) {{", "    {3}();", "    const {4} = (x) => {{", "      {5}(new Builder());", "    }};", "  }}", "}}"]


INDENTED_FUNCTION_LINES = ["# def {0}(): in a comment", "from .{1} import {2}", "def {0}({1}, y=\"def {4}():\"):", "    if {5}:", "        {2}({3},", "{4}())", "    return [{5} for x in y]", ""]
INDENTED_CLASS_LINES = ["class {0}({1}):", "    '''class {2}: def {3}(): '''", "    async def {1}(self):", "        def {2}():", "            {3}()", "", "        self.{4}(Builder())", "    {5} = 1"]


def _template(lines: list[str], name, text, joined) -> object:
    """The lines with names put in, as one expression: name(k) is the k-th name, text(s) a literal."""
    import re

    parts = []
    for bit in re.split(r"(\{\d\})", "\n".join(lines).replace("{{", "\x01").replace("}}", "\x02")):
        bit = bit.replace("\x01", "{").replace("\x02", "}")
        parts.append(name(int(bit[1])) if re.fullmatch(r"\{\d\}", bit) else text(bit))
    return joined(parts)


def sources(spark: SparkSession, d: str, indented: bool = False) -> DataFrame:
    """Source files whose names are all the words of a document: relative_path, language, content. Every fourth group of six
    words is a class with a method and a function in it, the others are functions; by braces, or by indentation."""
    w = F.col("w")
    forms = (INDENTED_CLASS_LINES, INDENTED_FUNCTION_LINES) if indented else (CLASS_LINES, FUNCTION_LINES)

    def group(g):
        of = lambda k: F.concat(F.element_at(w, (g * 6 + k + 1).cast("int")), F.lit("_"))
        made = lambda lines: _template(lines, of, F.lit, lambda parts: F.concat(*parts))
        return F.when(g % 4 == 3, made(forms[0])).otherwise(made(forms[1]))

    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))
    n = F.floor(F.size("w") / 6).cast("int")
    code = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), group), "\n")).otherwise("")
    # A generator, as no condition on the content may pass it: pushed below, the words would be matched anew for each name.
    path = F.concat(F.lit("code/"), F.col("doc_id").cast("string"), F.lit(".py" if indented else ".ts"))
    return words.select(path.alias("relative_path"), F.lit("python" if indented else "typescript").alias("language"), F.explode(F.array(code)).alias("content"))


# What an event does to the roles: op and item by its type, its number k and its value. The same text in both engines.
ROLE_OP = """CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'delete' ELSE 'grant' END WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'revoke' ELSE 'grant' END
 WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'disinherit' ELSE 'inherit' END ELSE CASE WHEN k % 9 = 0 THEN 'leave' WHEN k % 3 = 0 THEN 'unassign' ELSE 'assign' END END"""
ROLE_ITEM = """CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN k % 11 = 0 THEN 'not a permission' WHEN k % 7 = 0 THEN 'file:*' ELSE concat('file:read', k % 5) END WHEN event_type = 'click' THEN concat('r', k % 24) WHEN event_type = 'error' THEN concat('u', k % 13) END"""


def role_log(spark: SparkSession, d: str) -> DataFrame:
    """Changes of roles: seq, op, role, item."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("op", F.expr(ROLE_OP))
    role = F.when(F.col("op") != "leave", F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")))
    return e.select(F.col("event_id").alias("seq"), "op", role.alias("role"), F.when(~F.col("op").isin("create", "delete"), F.expr(ROLE_ITEM)).alias("item"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("relevant"))


#: The same views in DuckDB, for the oracle.
DUCK = {
    "v_files": "SELECT doc_id, concat(source, '/doc_', CAST(doc_id AS VARCHAR), '.', lang) AS relative_path, lang AS language, text AS content, substr(sha256(text), 1, 16) AS hash, n_chars AS size FROM documents",
    "v_manifest": "SELECT relative_path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE hash END AS hash FROM v_files WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('gone/', CAST(doc_id AS VARCHAR)), 'x' FROM v_files WHERE doc_id % 11 = 0",
    "v_query_log": "SELECT event_id, ts, user_id, event_type AS query, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INT) AS results_count FROM events",
    "v_audit": "SELECT event_id, ts, user_id, value, props, CASE event_type WHEN 'click' THEN 'tool_invocation' WHEN 'view' THEN 'file_change' WHEN 'purchase' THEN 'user_action' WHEN 'signup' THEN 'security_event' ELSE 'error' END AS type FROM events",
    "v_edges": "SELECT DISTINCT src, dst FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) x WHERE src IS NOT NULL AND src <> dst",
    "v_dag": "SELECT concat('N', n_nationkey) AS src, concat('R', n_regionkey) AS dst FROM nation UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM supplier",
    "v_tasks": "SELECT concat(conv_id, '-', turn) AS id, CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS parent_id, role AS label, CASE turn % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, text, conv_id, turn FROM conversations",
    "v_symbols": "SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_type AS type, p_brand AS file_path, p_size AS line FROM part",
    "v_calls": "SELECT l_orderkey AS file_id, l_linenumber AS line, l_partkey AS callee FROM lineitem",
    "v_commits": "SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'R' WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'D' WHEN 'signup' THEN 'A' ELSE 'M' END AS status, CASE WHEN event_type IN ('view', 'click', 'purchase', 'signup') THEN concat('src/u', user_id, '_', v, '.ts') ELSE concat('docs/u', user_id, '.md') END AS path, CASE WHEN event_type = 'view' THEN concat('src/u', user_id, '_', v - 1, '.ts') END AS old_path FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS v FROM events) e",
    # The names of the source view's groups and the line on which each begins, without any source text.
    "v_groups": "SELECT concat('code/', doc_id, '.ts') AS relative_path, g, 6 * (g - g // 4) + 8 * (g // 4) AS l, concat(w[6 * g + 1], '_') AS a, concat(w[6 * g + 2], '_') AS b, concat(w[6 * g + 3], '_') AS c, concat(w[6 * g + 4], '_') AS d, concat(w[6 * g + 5], '_') AS e, concat(w[6 * g + 6], '_') AS f FROM (SELECT doc_id, w, unnest(range(0, len(w) // 6)) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents) x) y",
    "v_role_log": "SELECT event_id AS seq, op, CASE WHEN op <> 'leave' THEN concat('r', user_id % 20) END AS role, CASE WHEN op NOT IN ('create', 'delete') THEN " + ROLE_ITEM + " END AS item FROM (SELECT *, " + ROLE_OP + " AS op FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) a) b",
    "v_truth": "SELECT doc_id, quality AS relevant FROM labels",
}
