"""Queries of the scalar functions (FN rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from .registry import query

_TOKENS = "list_filter(string_split_regex(lower(replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[^a-z0-9]+'), lambda t: length(t) > 1)"


def duck_tokens(text: str) -> str:
    return _TOKENS.replace("{0}", text)


@query("fn01_code_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {duck_tokens('text')} AS t FROM documents) x")
def fn01(spark, d):
    t = T.code_tokens(F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_NORM = r"trim(regexp_replace(lower(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-zA-Z])([0-9])', '\1 \2', 'g'), '([0-9])([a-zA-Z])', '\1 \2', 'g'), '_', ' ')), '\s+', ' ', 'g'))"


@query("fn02_normalize_symbol", f"SELECT p_partkey AS id, {_NORM.replace('{0}', 'p_name')} AS normal FROM part UNION ALL SELECT page_id, {_NORM.replace('{0}', 'url')} FROM pages")
def fn02(spark, d):
    a = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.normalize_symbol(F.col("p_name")).alias("normal"))
    return a.union(S.table(spark, d, "pages").select("page_id", T.normalize_symbol(F.col("url"))))


@query("fn03_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, 'steel blue') AS INT) AS distance FROM part")
def fn03(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lit("steel blue")).alias("distance"))


@query("fn04_similarity", "SELECT p_partkey, round(CASE WHEN greatest(length(p_name), length(p_brand)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(p_name, p_brand) / CAST(greatest(length(p_name), length(p_brand)) AS DOUBLE) END, 9) AS sim FROM part")
def fn04(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("p_brand")), 9).alias("sim"))


@query("fn05_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def fn05(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("fn06_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(concat(source, ':', '1', ':', '9', ':', text)), 1, 16) AS chunk FROM documents")
def fn06(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.short_hash(F.col("text")).alias("hash"), T.chunk_id(F.col("source"), F.lit(1), F.lit(9), F.col("text")).alias("chunk"))


@query("fn07_rolling_key", "SELECT count(DISTINCT text) AS n_keys FROM documents")
def fn07(spark, d):
    return S.table(spark, d, "documents").select(F.xxhash64("text").alias("k")).agg(F.countDistinct("k").alias("n_keys"))


_AGE = "date_diff('second', o_orderdate, TIMESTAMP '1997-01-01') / 86400.0"


@query("fn08_recency", f"SELECT o_orderkey, round(CASE WHEN o_orderdate IS NULL THEN 0.5 WHEN {_AGE} <= 0 THEN 1.0 ELSE exp(-({_AGE}) * ln(2) / 365) END, 9) AS score FROM orders")
def fn08(spark, d):
    now = F.lit("1997-01-01").cast("timestamp")
    return S.table(spark, d, "orders").select("o_orderkey", F.round(T.recency(F.col("o_orderdate"), now, 365), 9).alias("score"))


_ENTRY = "|".join(f"(?:{p})" for p in T.ENTRY_POINTS)
_PATHS = "concat(CASE page_id % 5 WHEN 0 THEN 'src/index' WHEN 1 THEN 'lib/Main' WHEN 2 THEN 'pkg/__init__' WHEN 3 THEN 'a/mod' ELSE url END, CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.txt' END)"


@query("fn09_entry_point", f"SELECT page_id, regexp_matches({_PATHS}, '(?i){_ENTRY}') AS entry FROM pages")
def fn09(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.is_entry_point(F.expr(_PATHS)).alias("entry"))


@query("fn10_has_export", "SELECT doc_id, trim(c) <> '' AND regexp_matches(c, '" + "(?m)" + "|".join(f"(?:{p})" for p in T.EXPORTS).replace("'", "''") + "') AS exported FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), '  export const x = 1') WHEN 1 THEN concat('func Run()', chr(10), text) WHEN 2 THEN '   ' ELSE text END AS c FROM documents) x")
def fn10(spark, d):
    c = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), '  export const x = 1') WHEN 1 THEN concat('func Run()', chr(10), text) WHEN 2 THEN '   ' ELSE text END")
    return S.table(spark, d, "documents").select("doc_id", T.is_exported(c).alias("exported"))


def _map_sql(names: dict[str, str], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {col} END"


_NODES = [*T.CHUNK_TYPES, "constructor_declaration", "singleton_method", "identifier"]
_PICK = "CASE p_partkey % " + str(len(_NODES)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NODES)) + " END"


@query("fn11_chunk_type", f"SELECT node, {_map_sql(T.CHUNK_TYPES, 'node')} AS kind, count(*) AS n FROM (SELECT {_PICK} AS node FROM part) x GROUP BY node")
def fn11(spark, d):
    return S.table(spark, d, "part").select(F.expr(_PICK).alias("node")).groupBy("node", T.chunk_type(F.col("node")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn12_definition_type", f"SELECT node, {_map_sql(T.DEFINITION_TYPES, 'node')} AS kind, count(*) AS n FROM (SELECT {_PICK} AS node FROM part) x GROUP BY node")
def fn12(spark, d):
    return S.table(spark, d, "part").select(F.expr(_PICK).alias("node")).groupBy("node", T.definition_type(F.col("node")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn13_comment_prefix", "SELECT language, CASE WHEN language IN ('python', 'ruby') THEN '#' ELSE '//' END AS mark FROM (SELECT DISTINCT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'ruby' ELSE lang END AS language FROM documents) x")
def fn13(spark, d):
    lang = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "ruby").otherwise(F.col("lang"))
    return S.table(spark, d, "documents").select(lang.alias("language")).distinct().select("language", T.comment_prefix(F.col("language")).alias("mark"))


@query("fn14_docstring_preview", r"""
SELECT doc_id, CASE WHEN length(p) <= 200 THEN p ELSE concat(rtrim(substr(p, 1, 197)), '...') END AS preview FROM (
  SELECT doc_id, trim(array_to_string(list_filter(list_transform(string_split(concat('/** ', text, chr(10), '* end */'), chr(10)), lambda l: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(l), '^/\*\*?', ''), '^\*/$', ''), '^\*', ''), '^//', ''), '^#', ''), '^''''''', ''), '^"{3}', ''))), lambda x: x <> ''), ' ')) AS p FROM documents) x""")
def fn14(spark, d):
    doc = F.concat(F.lit("/** "), F.col("text"), F.lit("\n* end */"))
    return S.table(spark, d, "documents").select("doc_id", T.docstring_preview(doc).alias("preview"))


_WORDS = f"SELECT unnest({duck_tokens('text')}) AS w FROM documents"


@query("fn15_noise_names", f"SELECT w, count(*) AS n FROM ({_WORDS}) x WHERE length(w) <= 2 OR w IN ({', '.join(repr(b) for b in T.BUILTIN_NAMES)}) GROUP BY w")
def fn15(spark, d):
    w = S.table(spark, d, "documents").select(F.explode(T.code_tokens(F.col("text"))).alias("w"))
    return w.where(T.is_noise_name(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("fn16_query_key", "SELECT event_id, lower(trim(concat(' ', upper(event_type), ' '))) AS bare, concat(lower(trim(event_type)), '|', CASE WHEN user_id % 2 = 0 THEN 'function' ELSE '' END, '|', 'en') AS filtered FROM events")
def fn16(spark, d):
    q = F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))
    return S.table(spark, d, "events").select("event_id", T.query_key(q).alias("bare"), T.query_key(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "function"), F.lit("en")).alias("filtered"))


_Q = """concat('Find "', event_type, '" Function  Foo ', CAST(user_id AS VARCHAR), ' in ''x'' of type Bar and some more words to cut')"""


@query("fn17_query_pattern", rf"""
SELECT event_id, CASE WHEN length(p) > 50 THEN concat(substr(p, 1, 50), '...') ELSE p END AS pattern FROM (
  SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({_Q})), '\s+', ' ', 'g'), '"[^"]*"', '<string>', 'g'), '''[^'']*''', '<string>', 'g'), '\b[0-9]+\b', '<num>', 'g'), '\b(function|method|class|interface|type)\s+\w+', '\1 <name>', 'g') AS p FROM events) x""")
def fn17(spark, d):
    return S.table(spark, d, "events").select("event_id", T.query_pattern(F.expr(_Q.replace("VARCHAR", "STRING").replace("''x''", "\\'x\\'"))).alias("pattern"))


_POWER = "CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END"


@query("fn18_human_bytes", f"""SELECT doc_id, CASE WHEN n = 0 THEN '0 B' ELSE concat(regexp_replace(printf('%.2f', floor(n / pow(1024.0, {_POWER}) * 100 + 0.5) / 100), '\\.?0+$', ''), ' ', u) END AS short,
  CASE WHEN n = 0 THEN '0 B' ELSE concat(printf('%.1f', floor(n / pow(1024.0, {_POWER}) * 10 + 0.5) / 10), ' ', u) END AS fixed
  FROM (SELECT doc_id, n, ['B', 'KB', 'MB', 'GB'][1 + {_POWER}] AS u FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars * (doc_id % 997) END AS n FROM documents) y) x""")
def fn18(spark, d):
    n = F.when(F.col("doc_id") % 50 == 0, 0).otherwise(F.col("n_chars") * (F.col("doc_id") % 997))
    return S.table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", T.bytes_short(F.col("n")).alias("short"), T.bytes_fixed(F.col("n")).alias("fixed"))


@query("fn19_thousands", "SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', floor(n / 1e6 * 10 + 0.5) / 10) WHEN n >= 1000 THEN printf('%.1fK', floor(n / 1e3 * 10 + 0.5) / 10) ELSE CAST(n AS VARCHAR) END AS text FROM (SELECT doc_id, n_chars * (doc_id % 500) AS n FROM documents) x")
def fn19(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.thousands(F.col("n_chars") * (F.col("doc_id") % 500)).alias("text"))


@query("fn20_round_half_up", "SELECT c_custkey, floor(c_acctbal / 7 * 100 + 0.5) / 100 AS r FROM customer")
def fn20(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", T.round_half_up(F.col("c_acctbal") / 7).alias("r"))


@query("fn21_resource_sizes", r"""SELECT k, CASE WHEN m THEN CAST(floor(CAST(v AS DOUBLE) * CASE u WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END) AS BIGINT) END AS bytes,
  CASE WHEN regexp_matches(t, '^([0-9]+(?:\.[0-9]+)?)\s*%$') THEN CASE WHEN CAST(regexp_extract(t, '^([0-9.]+)', 1) AS DOUBLE) <= 100 THEN CAST(regexp_extract(t, '^([0-9.]+)', 1) AS DOUBLE) / 100 END END AS cpu,
  CASE WHEN b >= 1073741824 THEN concat(b // 1073741824, 'g') WHEN b >= 1048576 THEN concat(b // 1048576, 'm') WHEN b >= 1024 THEN concat(b // 1024, 'k') ELSE CAST(b AS VARCHAR) END AS back
  FROM (SELECT p_partkey AS k, t, b, regexp_matches(t, '(?i)^([0-9]+(?:\.[0-9]+)?)\s*([kmg])?b?$') AS m, regexp_extract(t, '^([0-9.]+)', 1) AS v, lower(regexp_extract(t, '(?i)^([0-9]+(?:\.[0-9]+)?)\s*([kmg])?b?$', 2)) AS u
    FROM (SELECT p_partkey, concat(p_size, CASE p_partkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN '.5 GB' WHEN 2 THEN '%' WHEN 3 THEN 'K' WHEN 4 THEN '' ELSE ' parsecs' END) AS t, CAST(p_size AS BIGINT) * p_partkey * p_partkey AS b FROM part) y) x""")
def fn21(spark, d):
    t = F.expr("concat(p_size, CASE p_partkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN '.5 GB' WHEN 2 THEN '%' WHEN 3 THEN 'K' WHEN 4 THEN '' ELSE ' parsecs' END)")
    b = F.col("p_size").cast("long") * F.col("p_partkey") * F.col("p_partkey")
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.parse_memory(t).alias("bytes"), T.parse_cpu(t).alias("cpu"), T.format_memory(b).alias("back"))


@query("fn22_redact", rf"SELECT doc_id, md5(r) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{T.SECRET_TOKEN}', '[REDACTED]', 'g'), '{T.EMAIL}', '[EMAIL]', 'g'), '\b[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\b', '[IP]', 'g') AS r FROM documents) x")
def fn22(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("digest"))


@query("fn23_redact_fields", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '[REDACTED]' ELSE k END AS a, k AS b FROM (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events) x")
def fn23(spark, d):
    k = F.get_json_object("props", "$.k")
    fields = T.redact_fields(F.create_map(F.when(F.col("user_id") % 2 == 0, F.lit("userApiKey")).otherwise(F.lit("name")), k, F.lit("k"), k))
    return S.table(spark, d, "events").select("event_id", "user_id", fields.alias("m")).select("event_id", F.coalesce(F.col("m")["userApiKey"], F.col("m")["name"]).alias("a"), F.col("m")["k"].alias("b"))


@query("fn24_integrity_hash", """SELECT event_id, substr(sha256(concat('{"event_id":', event_id, ',"event_type":"', event_type, '","user_id":', user_id, '}')), 1, 16) AS hash FROM events""")
def fn24(spark, d):
    return S.table(spark, d, "events").select("event_id", T.integrity_hash(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("hash"))


_URLS = "concat(CASE page_id % 6 WHEN 0 THEN '/etc/' WHEN 1 THEN '../' WHEN 2 THEN 'C:/Windows/' WHEN 3 THEN '/proc/' ELSE '' END, url)"


@query("fn25_path_error", f"SELECT page_id, CASE WHEN contains(p, '../') THEN 'Path traversal detected' WHEN regexp_matches(p, '(?i)^/(etc|proc|sys|dev)/|^[a-z]:/(windows|system32)') THEN 'Access to system path denied' END AS error FROM (SELECT page_id, {_URLS} AS p FROM pages) x")
def fn25(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.path_error(F.expr(_URLS)).alias("error"))


@query("fn26_query_error", "SELECT item_id, CASE WHEN q = '' THEN 'Query must be a non-empty string' WHEN length(q) > 10000 THEN 'Query too long (max 10000 characters)' END AS error FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN repeat(text, 60) ELSE text END AS q FROM benchmark) x")
def fn26(spark, d):
    q = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.repeat("text", 60)).otherwise(F.col("text"))
    return S.table(spark, d, "benchmark").select("item_id", T.query_error(q).alias("error"))


@query("fn27_number_error", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'limit must be at least 10' WHEN p_size > 40 THEN 'limit must be at most 40' END AS error FROM part")
def fn27(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.number_error(F.col("p_size").cast("double"), 10, 40, "limit").alias("error"))


@query("fn28_glob", rf"SELECT page_id, regexp_matches(url, '{T.glob_regex('http*://**/en/*')}') AS a, regexp_matches(url, '{T.glob_regex('**/{de,fr}/**')}') AS b FROM pages")
def fn28(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.in_scope(F.col("url"), ["http*://**/en/*"]).alias("a"), T.in_scope(F.col("url"), ["**/{de,fr}/**"]).alias("b"))


# Granted and requested permissions, made from nations and regions.
_GRANT = "CASE n_nationkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'read:*' WHEN 2 THEN 'read:file:src/*' WHEN 3 THEN 'write:file' WHEN 4 THEN 'perm1' WHEN 5 THEN 'read:file:src/a' ELSE '*:file:**x' END"
_ASK = "CASE r_regionkey % 5 WHEN 0 THEN 'read:file:src/a' WHEN 1 THEN 'write:file:b' WHEN 2 THEN 'perm1' WHEN 3 THEN 'read:file' ELSE 'delete:file:b/x' END"
PERMISSION_SQL = """CASE WHEN g = '*' THEN true WHEN NOT contains(g, ':') OR NOT contains(q, ':') THEN g = q
 WHEN NOT ((split_part(g, ':', 1) = '*' OR split_part(g, ':', 1) = split_part(q, ':', 1)) AND (split_part(g, ':', 2) = '*' OR split_part(g, ':', 2) = split_part(q, ':', 2))) THEN false
 WHEN split_part(g, ':', 3) = '' THEN true WHEN split_part(q, ':', 3) = '' THEN false WHEN split_part(g, ':', 3) = split_part(q, ':', 3) THEN true
 WHEN right(g, 1) = '*' THEN starts_with(split_part(q, ':', 3), rtrim(split_part(g, ':', 3), '*') ) WHEN contains(g, '**') THEN starts_with(split_part(q, ':', 3), split_part(split_part(g, ':', 3), '**', 1)) AND ends_with(split_part(q, ':', 3), split_part(split_part(g, ':', 3), '**', 2)) ELSE false END"""


@query("fn29_permission_match", f"SELECT g, q, {PERMISSION_SQL} AS ok FROM (SELECT DISTINCT {_GRANT} AS g, {_ASK} AS q FROM nation CROSS JOIN region) x")
def fn29(spark, d):
    both = S.table(spark, d, "nation").crossJoin(F.broadcast(S.table(spark, d, "region")))  # five rows
    return both.select(F.expr(_GRANT).alias("g"), F.expr(_ASK).alias("q")).distinct().withColumn("ok", T.permission_matches(F.col("g"), F.col("q")))


@query("fn30_permission_valid", f"SELECT n_nationkey, p = '*' OR regexp_matches(p, '^[a-zA-Z0-9_-]+$') OR (contains(p, ':') AND split_part(p, ':', 1) <> '' AND split_part(p, ':', 2) <> '') AS ok FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN {_GRANT} WHEN n_nationkey % 3 = 1 THEN ':x' ELSE 'a b' END AS p FROM nation) x")
def fn30(spark, d):
    p = F.expr(f"CASE WHEN n_nationkey % 3 = 0 THEN {_GRANT} WHEN n_nationkey % 3 = 1 THEN ':x' ELSE 'a b' END")
    return S.table(spark, d, "nation").select("n_nationkey", T.permission_valid(p).alias("ok"))


_HREF = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


def hrefs(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("fn32_import_kind", f"""SELECT href, CASE WHEN starts_with(p, './') OR starts_with(p, '../') THEN 'relative' WHEN starts_with(p, '/') THEN 'absolute' ELSE 'package' END AS kind,
  CASE WHEN p = './' OR regexp_matches(p, '^\\./[^/]+$') THEN 'easy' WHEN len(regexp_extract_all(p, '\\.\\./')) > 2 THEN 'hard' ELSE 'medium' END AS difficulty
  FROM (SELECT DISTINCT href, CASE length(href) % 4 WHEN 0 THEN concat('.', href) WHEN 1 THEN concat('../../..', href) WHEN 2 THEN href ELSE concat('@', href) END AS p FROM ({_HREF}) y) x""")
def fn32(spark, d):
    p = F.expr("CASE length(href) % 4 WHEN 0 THEN concat('.', href) WHEN 1 THEN concat('../../..', href) WHEN 2 THEN href ELSE concat('@', href) END")
    return hrefs(spark, d).select("href").distinct().select("href", T.import_kind(p).alias("kind"), T.import_difficulty(p).alias("difficulty"))


@query("fn33_grep_line", r"SELECT event_id, CASE WHEN event_id % 3 > 0 THEN concat('src/', event_type, '.ts') END AS file, CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS INT) END AS line, CASE WHEN event_id % 3 > 0 THEN 'x: y' END AS content FROM events")
def fn33(spark, d):
    text = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("src/"), "event_type", F.lit(".ts:"), F.col("user_id").cast("string"), F.lit(":  x: y "))).otherwise(F.lit("no match"))
    return S.table(spark, d, "events").select("event_id", T.grep_line(text).alias("g")).select("event_id", "g.file", "g.line", "g.content")


@query("fn34_compiler_message", "SELECT event_id, concat(event_type, '.ts') AS file, CAST(user_id AS INT) AS line, 7 AS col, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, concat('TS', 1000 + user_id) AS rule, concat('TS', 1000 + user_id, ': bad ', event_type) AS message FROM events WHERE event_id % 5 > 0")
def fn34(spark, d):
    line = F.expr("CASE WHEN event_id % 5 > 0 THEN concat(event_type, '.ts(', user_id, ',7): ', CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END, ' TS', 1000 + user_id, ': bad ', event_type) ELSE 'Found 3 errors.' END")
    return S.table(spark, d, "events").select("event_id", T.compiler_message(line).alias("m")).where("m is not null").select("event_id", "m.*")


@query("fn35_lint_messages", "SELECT event_id, event_type AS file, CASE WHEN user_id % 3 = 0 THEN 1 ELSE CAST(user_id % 3 AS INT) END AS line, CASE WHEN event_id % 3 = 2 THEN 'error' ELSE 'warning' END AS severity FROM events WHERE event_id % 3 > 0")
def fn35(spark, d):
    report = F.expr("""concat('[{"filePath":"', event_type, '","messages":[{"line":', user_id % 3, ',"column":2,"message":"m","ruleId":"r","severity":', event_id % 3, '}]}]')""")
    return S.table(spark, d, "events").select("event_id", F.explode(T.lint_messages(report)).alias("m")).select("event_id", "m.file", "m.line", "m.severity")


@query("fn36_escapes", r"""SELECT n_nationkey, regexp_replace(t, '([&%$#_{}])', '\\\1', 'g') AS latex, CASE WHEN regexp_matches(t, '[,"\n]') THEN concat('"', replace(t, '"', '""'), '"') ELSE t END AS csv FROM (SELECT n_nationkey, concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ', "50%"' ELSE '_x' END) AS t FROM nation) x""")
def fn36(spark, d):
    t = F.expr("""concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN ', "50%"' ELSE '_x' END)""")
    return S.table(spark, d, "nation").select("n_nationkey", T.latex_escape(t).alias("latex"), T.csv_field(t).alias("csv"))


@query("fn37_naive_tokens", "SELECT doc_id, CAST(greatest(0, naive - used) AS BIGINT) AS saved FROM (SELECT doc_id, CAST(ceil(length(text) / 8.0) AS BIGINT) AS used, coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) END, 3 * CAST(ceil(length(text) / 8.0) AS BIGINT)) AS naive FROM documents) x")
def fn37(spark, d):
    used = F.ceil(F.length("text") / 8).cast("long")
    naive = T.naive_tokens(F.when(F.col("doc_id") % 2 == 0, T.token_estimate(F.col("text"))), used)
    return S.table(spark, d, "documents").select("doc_id", F.greatest(F.lit(0), naive - used).cast("long").alias("saved"))


@query("fn38_filter_builder", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def fn38(spark, d):
    return S.table(spark, d, "documents").where(T.equals_filter(lang="de", source="src3")).select("doc_id")


@query("fn39_extractors", f"SELECT DISTINCT page_id, href FROM ({_HREF}) x")
def fn39(spark, d):
    return hrefs(spark, d).distinct()
