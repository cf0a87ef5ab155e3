"""Queries of retrieval, vectors, chunking and incremental maintenance (TX, VX, CK, INC and their parts)."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, incremental, search, vector
from ..sources import tables as S
from ..sources.shared import written
from ..sources.versions import Versions
from .records import _limited
from .registry import query
from .scalar import _NORM, duck_tokens


def _queries(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple[str, ...], search.TextIndex] = {}


def _text_index(spark, d):
    """The stored index of a corpus, built once in an application for the files that the table has, or again where its folder
    was cleared; every keyword search reads it."""
    key = (spark.sparkContext.applicationId, d, *sorted(S.table(spark, d, "documents").inputFiles()))
    if key in _INDEXES:
        try:
            _INDEXES[key].stats.collect()
        except (PySparkException, Py4JError):
            del _INDEXES[key]
    if key not in _INDEXES:
        _INDEXES[key] = search.text_index(S.table(spark, d, "documents"))
    return _INDEXES[key]


def _keyword(spark, d, k=30):
    return search.bm25_of(_text_index(spark, d), _queries(spark, d), k)


_TF = f"tok AS (SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len({duck_tokens('text')}) AS dl FROM documents), st AS (SELECT count(*) AS n, sum(dl) AS total, avg(dl) AS avgdl FROM dl), idf AS (SELECT term, count(*) AS df, ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term)"
_Q = f"q AS (SELECT item_id AS query_id, unnest({duck_tokens('text')}) AS term FROM benchmark), qn AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL)"
_BM25 = f"{_TF}, {_Q}, bm AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM st)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qn USING (term) JOIN dl USING (doc_id) GROUP BY ALL), kw AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm) x WHERE rank <= 30)"


@query("tx01_bm25", f"WITH {_BM25} SELECT * FROM kw WHERE rank <= 10")
def tx01(spark, d):
    return _keyword(spark, d, 10)


@query("tx02b_search_after_update", f"WITH {_BM25} SELECT * FROM kw WHERE rank <= 10")
def tx02b(spark, d):
    """An older state of the corpus is indexed, then brought up to date by the documents that came, changed or went."""
    now = S.table(spark, d, "documents").select("doc_id", "text")
    was = now.where("doc_id % 7 <> 1").withColumn("text", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("stale words "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    was = was.unionByName(now.where("doc_id % 9 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("a document that went since").alias("text")))
    fresh = now.where("doc_id % 7 = 1 or doc_id % 5 = 2")
    index = search.updated(search.text_index(was), was.where("doc_id < 0").select("doc_id"), fresh)
    return search.bm25_of(index, _queries(spark, d))


@query("tx02c_index_tables", f"WITH {_TF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def tx02c(spark, d):
    """Builds the stored index, if this application has none, and gives its table of terms."""
    return _text_index(spark, d).frequencies.withColumn("idf", F.round("idf", 9))


@query("ag01_term_frequency", f"WITH {_TF} SELECT * FROM tf")
def ag01(spark, d):
    return search.postings(S.table(spark, d, "documents"))


@query("ag03_idf", f"WITH {_TF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def ag03(spark, d):
    docs = S.table(spark, d, "documents")
    return search.inverse_frequency(search.postings(docs), search.corpus_stats(search.lengths(docs))).withColumn("idf", F.round("idf", 9))


@query("ag04_corpus_stats", f"WITH {_TF} SELECT n, CAST(total AS BIGINT) AS total, round(avgdl, 9) AS avgdl FROM st")
def ag04(spark, d):
    return search.corpus_stats(search.lengths(S.table(spark, d, "documents"))).withColumn("avgdl", F.round("avgdl", 9))


@query("tx02_bm25_stats", f"WITH {_TF} SELECT (SELECT n FROM st) AS n, (SELECT count(*) FROM idf) AS terms, (SELECT round(avgdl, 9) FROM st) AS avgdl")
def tx02(spark, d):
    docs = S.table(spark, d, "documents")
    terms = search.postings(docs).agg(F.countDistinct("term").alias("terms"))
    return search.corpus_stats(search.lengths(docs)).crossJoin(terms).select("n", "terms", F.round("avgdl", 9).alias("avgdl"))


@query("jn01_terms_postings", f"WITH {_TF}, {_Q} SELECT query_id, doc_id, term, tf, times FROM tf JOIN qn USING (term)")
def jn01(spark, d):
    q = _queries(spark, d).select("query_id", F.explode(T.code_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return search.postings(S.table(spark, d, "documents")).join(q, "term").select("query_id", "doc_id", "term", "tf", "times")


@query("jn02_postings_lengths", f"WITH {_TF} SELECT doc_id, term, tf, dl FROM tf JOIN dl USING (doc_id)")
def jn02(spark, d):
    docs = S.table(spark, d, "documents")
    return search.postings(docs).join(search.lengths(docs), "doc_id").select("doc_id", "term", "tf", "dl")


@query("jn19_corpus_cross", f"WITH {_TF} SELECT doc_id, round(dl / (SELECT avgdl FROM st), 9) AS relative FROM dl")
def jn19(spark, d):
    dl = search.lengths(S.table(spark, d, "documents"))
    return dl.crossJoin(F.broadcast(search.corpus_stats(dl))).select("doc_id", F.round(F.col("dl") / F.col("avgdl"), 9).alias("relative"))


_NAMES = "['steel_blue', 'linen', 'Metallic_Green', 'forest-almond', 'blue']"
_FUZZY = f"""qs AS (SELECT CAST(i AS INT) AS query_id, {_NAMES}[i] AS query FROM range(1, 6) r(i)), sy AS (SELECT name, type, lower(name) AS low, {_NORM.replace('{0}', 'name')} AS nrm FROM v_symbols), qn AS (SELECT query_id, lower(query) AS ql, {_NORM.replace('{0}', 'query')} AS qm FROM qs),
 sc AS (SELECT query_id, name, type, CASE WHEN low = ql THEN 1.0 ELSE least(1.0, greatest(1.0 - levenshtein(qm, nrm) / CAST(greatest(length(qm), length(nrm)) AS DOUBLE), 1.0 - levenshtein(ql, low) / CAST(greatest(length(ql), length(low)) AS DOUBLE)) + CASE WHEN contains(low, ql) OR contains(nrm, qm) THEN 0.2 ELSE 0.0 END) END AS raw FROM sy CROSS JOIN qn)"""


def _names(spark):
    return spark.createDataFrame(list(enumerate(["steel_blue", "linen", "Metallic_Green", "forest-almond", "blue"], 1)), "query_id int, query string")


@query("tx03_fuzzy_symbols", f"WITH {_FUZZY} SELECT query_id, rank, name, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INT) AS rank FROM (SELECT query_id, name, round(raw, 6) AS score FROM sc WHERE round(raw, 6) >= 0.3) y) x WHERE rank <= 10")
def tx03(spark, d):
    return search.fuzzy(S.symbols(spark, d), _names(spark))


@query("tx10_search_symbols", f"WITH {_FUZZY} SELECT query_id, rank, name, floor(score * 100 + 0.5) / 100 AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INT) AS rank FROM (SELECT query_id, name, round(raw, 6) AS score FROM sc WHERE round(raw, 6) >= 0.4 AND type = 'STANDARD') y) x WHERE rank <= 5")
def tx10(spark, d):
    out = search.fuzzy(S.symbols(spark, d), _names(spark), k=5, threshold=0.4, types=["STANDARD"])
    return out.withColumn("score", T.round_half_up(F.col("score")))


@query("jn20_fuzzy_pairs", f"WITH {_FUZZY} SELECT query_id, count(*) AS n FROM sc WHERE round(raw, 6) >= 0.5 GROUP BY query_id")
def jn20(spark, d):
    return search.fuzzy(S.symbols(spark, d), _names(spark), k=1 << 30, threshold=0.5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


# Queries are the vectors whose id 50 divides, against all; the document of a vector is its id.
_KNN = "sem AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(1 - list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))), 10) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0) y) x WHERE rank <= 30)"


def _vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _query_vectors(spark, d):
    return S.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _semantic(spark, d, k=30):
    return vector.knn(_vectors(spark, d), _query_vectors(spark, d), k)


@query("vx01_knn", f"WITH {_KNN} SELECT query_id, rank, doc_id, score FROM sem WHERE rank <= 10")
def vx01(spark, d):
    return _semantic(spark, d, 10)


@query("vx02_knn_filtered", f"WITH {_KNN.replace('FROM embeddings v JOIN', 'FROM (SELECT * FROM embeddings WHERE label = 1) v JOIN')} SELECT query_id, rank, doc_id, score FROM sem WHERE rank <= 10")
def vx02(spark, d):
    return vector.knn(_vectors(spark, d).where("label = 1"), _query_vectors(spark, d), 10)


@query("jn21_query_by_vectors", f"WITH {_KNN} SELECT query_id, round(sum(score), 5) AS total FROM sem GROUP BY query_id")
def jn21(spark, d):
    return _semantic(spark, d).groupBy("query_id").agg(F.round(F.sum("score"), 5).alias("total"))


@query("vx03_embed")
def vx03(spark, d):
    return vector.hashing_embedding(S.table(spark, d, "documents").select("doc_id", "text"), dims=64).drop("text")


_FUSE = f"WITH {_BM25}, {_KNN}, span AS (SELECT query_id, greatest(max(score), 0) AS hi, least(min(score), 0) AS lo FROM kw GROUP BY query_id), fused AS (SELECT query_id, doc_id, coalesce(s.score, 0.0) AS semantic, CASE WHEN hi > 0 THEN (coalesce(k.score, 0.0) - lo) / (hi - lo) ELSE 0.0 END AS keyword FROM (SELECT * FROM sem) s FULL JOIN kw k USING (query_id, doc_id) LEFT JOIN span USING (query_id)), hy AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT *, round(0.7 * semantic + (1 - 0.7) * keyword, 6) AS score FROM fused) y) x)"


@query("tx04_hybrid_linear", f"{_FUSE} SELECT query_id, rank, doc_id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, score FROM hy WHERE rank <= 10")
def tx04(spark, d):
    kw = _keyword(spark, d)
    return search.hybrid(_semantic(spark, d), kw).select("query_id", "rank", "doc_id", F.round("semantic", 6).alias("semantic"), F.round("keyword", 6).alias("keyword"), "score")


@query("tx05_hybrid_rrf", f"WITH {_BM25}, {_KNN}, j AS (SELECT query_id, doc_id, s.rank AS rs, k.rank AS rk FROM sem s FULL JOIN kw k USING (query_id, doc_id)), m AS (SELECT *, greatest(count(rs) OVER (PARTITION BY query_id), count(rk) OVER (PARTITION BY query_id)) + 1 AS last FROM j) SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT query_id, doc_id, round(0.7 / (60 + coalesce(rs, last)) + (1 - 0.7) / (60 + coalesce(rk, last)), 9) AS score FROM m) y) x WHERE rank <= 10")
def tx05(spark, d):
    return search.rrf(_semantic(spark, d), _keyword(spark, d))


@query("jn03_fusion_join", f"{_FUSE} SELECT query_id, count(*) AS n, round(sum(semantic), 5) AS semantic, round(sum(keyword), 5) AS keyword FROM hy GROUP BY query_id")
def jn03(spark, d):
    kw = _keyword(spark, d)
    return search.hybrid(_semantic(spark, d), kw, 1 << 30).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("semantic"), 5).alias("semantic"), F.round(F.sum("keyword"), 5).alias("keyword"))


@query("st01_union_ids", f"WITH {_BM25}, {_KNN} SELECT query_id, doc_id FROM sem UNION SELECT query_id, doc_id FROM kw")
def st01(spark, d):
    kw = _keyword(spark, d)
    return _semantic(spark, d).select("query_id", "doc_id").union(kw.select("query_id", "doc_id")).distinct()


@query("jn11_attach_rows", f"{_FUSE} SELECT query_id, doc_id, relative_path FROM hy JOIN v_files USING (doc_id) WHERE rank <= 30")
def jn11(spark, d):
    kw = _keyword(spark, d)
    return search.hybrid(_semantic(spark, d), kw, 30).join(S.files(spark, d), "doc_id").select("query_id", "doc_id", "relative_path")


_RANK = "round(greatest(0, least(1, greatest(0, least(1, semantic)) * 0.5 + greatest(0, least(1, keyword)) * 0.2 + 0.5 * 0.1 + CASE WHEN regexp_matches(content, '(?m)" + "|".join(f"(?:{p})" for p in T.EXPORTS) + "') THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(relative_path, '(?i)" + "|".join(f"(?:{p})" for p in T.ENTRY_POINTS) + "') THEN 0.1 ELSE 0.0 END)), 6)"


@query("tx06_ranker", f"{_FUSE} SELECT query_id, doc_id, {_RANK} AS score FROM hy JOIN v_files USING (doc_id) WHERE rank <= 20")
def tx06(spark, d):
    kw = _keyword(spark, d)
    rows = search.hybrid(_semantic(spark, d), kw, 20).join(S.files(spark, d), "doc_id")
    return rows.select("query_id", "doc_id", F.round(search.rank_score(F.col("semantic"), F.col("keyword"), F.lit(0.5), T.is_exported(F.col("content")), T.is_entry_point(F.col("relative_path"))), 6).alias("score"))


@query("tx07_search_hybrid", rf"{_FUSE}, f AS (SELECT query_id, doc_id, relative_path, {_RANK} AS score FROM hy JOIN v_files USING (doc_id) WHERE rank <= 60 AND regexp_matches(relative_path, '{T.glob_regex('src*/**')}') AND NOT regexp_matches(relative_path, '{T.glob_regex('**/*.de')}')) SELECT query_id, rank, doc_id, relative_path, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f) x WHERE rank <= 10")
def tx07(spark, d):
    kw = _keyword(spark, d)
    return search.search(S.files(spark, d), _semantic(spark, d), kw, include=["src*/**"], exclude=["**/*.de"], ranking=True, compat=True)


@query("tx08_search_modes", f"WITH {_BM25} SELECT query_id, rank, doc_id, relative_path, score FROM kw JOIN v_files USING (doc_id) WHERE rank <= 10")
def tx08(spark, d):
    return search.search(S.files(spark, d), None, _keyword(spark, d))


@query("tx09_ranking_factors", "SELECT doc_id, regexp_matches(content, '(?m)" + "|".join(f"(?:{p})" for p in T.EXPORTS) + "') AS exported, regexp_matches(relative_path, '(?i)" + "|".join(f"(?:{p})" for p in T.ENTRY_POINTS) + "') AS entry_point FROM v_files WHERE trim(content) <> ''")
def tx09(spark, d):
    return S.files(spark, d).where("trim(content) <> ''").select("doc_id", T.is_exported(F.col("content")).alias("exported"), T.is_entry_point(F.col("relative_path")).alias("entry_point"))


@query("tx11_read_context", "WITH x AS (SELECT relative_path, string_split(content, chr(10)) AS l, list_position(list_transform(string_split(content, chr(10)), lambda s: contains(s, 'License')), true) AS pos FROM v_files WHERE contains(content, 'License')) SELECT relative_path, CAST(greatest(1, pos - 5) AS INT) AS first, CAST(least(len(l), pos + 55) AS INT) AS last, array_to_string(l[greatest(1, pos - 5):least(len(l), pos + 55)], chr(10)) AS snippet FROM x")
def tx11(spark, d):
    return search.context(S.files(spark, d), "License")


@query("tx12_grep", "SELECT relative_path, CAST(i AS INT) AS line, trim(c) AS content, CASE WHEN contains(c, 'License') THEN CAST(1 AS DOUBLE) ELSE 0.8 END AS score FROM (SELECT relative_path, unnest(string_split(content, chr(10))) AS c, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM v_files) x WHERE contains(lower(c), 'license')")
def tx12(spark, d):
    return search.grep(S.files(spark, d), "License")


@query("tx13_query_generator", "SELECT relative_path, concat('where is ', s) AS query FROM (SELECT relative_path, regexp_extract(content, '[A-Z][a-z]{4,}') AS s FROM v_files) x WHERE s <> '' ORDER BY relative_path LIMIT 10")
def tx13(spark, d):
    first = F.regexp_extract("content", r"([A-Z][a-z]{4,})", 1)
    return S.files(spark, d).select("relative_path", first.alias("symbol")).where("symbol <> ''").select("relative_path", F.concat(F.lit("where is "), "symbol").alias("query")).orderBy("relative_path").limit(10)


# ---- chunking

_CHUNK = "SELECT relative_path, CAST(s + 1 AS INT) AS start_line, CAST(least(len(l), s + {size}) AS INT) AS end_line, array_to_string(l[s + 1:s + {size}], chr(10)) AS content FROM (SELECT relative_path, l, unnest(range(0, len(l), {step})) AS s FROM (SELECT relative_path, string_split(content, chr(10)) AS l FROM v_files) y) x"


@query("ck01_line_chunks", f"SELECT relative_path, start_line, end_line, md5(content) AS digest, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM ({_CHUNK.format(size=16, step=12)}) z WHERE regexp_matches(content, '\\S')")
def ck01(spark, d):
    return chunk.line_chunks(S.files(spark, d), *chunk.windows(64)).select("relative_path", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"), "tokens")


@query("ck02_suite_chunks", f"SELECT relative_path, start_line, end_line, length(content) AS chars FROM ({_CHUNK.format(size=50, step=38)}) z WHERE regexp_matches(content, '\\S')")
def ck02(spark, d):
    return chunk.line_chunks(S.files(spark, d), 50, 38).select("relative_path", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


@query("ck03_packed_chunks")
def ck03(spark, d):
    return chunk.packed_chunks(S.files(spark, d), 128)


# Recursive: each part from the end of the one before it. ofs: the offset of each line.
_SPLIT = """f AS (SELECT relative_path, doc_id, l, list_transform(range(0, len(l) + 1), lambda j: coalesce(CAST(list_sum(list_transform(l[1:j], lambda x: length(x) + 1)) AS BIGINT), 0)) AS ofs,
  concat('// Scope: ', relative_path, chr(10), '// Symbol: document doc_', doc_id, chr(10), '// Part: ') AS head, concat(chr(10), '// Grounding (start of symbol):', chr(10), array_to_string(list_transform(l[1:2], lambda x: CASE WHEN x = '' THEN '//' ELSE concat('// ', x) END), chr(10))) AS more
  FROM (SELECT relative_path, doc_id, string_split(content, chr(10)) AS l FROM v_files WHERE regexp_matches(content, '\\S')) x),
 pt AS (SELECT relative_path, doc_id, l, ofs, head, more, 0 AS part, 0 AS s, greatest(1, len(list_filter(ofs[2:], lambda x: x - 1 <= greatest(0, 512 - 2 - length(head) - 1)))) AS e FROM f
  UNION ALL SELECT relative_path, doc_id, l, ofs, head, more, part + 1, n, greatest(n + 1, n + len(list_filter(ofs[n + 2:], lambda x: x - ofs[n + 1] - 1 <= greatest(0, 512 - 2 - length(head) - length(CAST(part + 2 AS VARCHAR)) - length(more)))))
  FROM (SELECT *, e - CASE WHEN e - s > 1 THEN least(greatest(1, CAST(floor((e - s) * 0.25) AS INT)), e - s - 1) ELSE 0 END AS n FROM pt WHERE e < len(l)) y)"""


@query("ck03b_split_chunks", f"WITH RECURSIVE {_SPLIT} SELECT relative_path, CAST(part AS INT) AS part, CAST(s + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line, concat('doc_', doc_id, '_part', part) AS name, md5(concat(head, part + 1, CASE WHEN part > 0 THEN more ELSE '' END, chr(10), chr(10), array_to_string(l[s + 1:e], chr(10)))) AS digest FROM pt")
def ck03b(spark, d):
    f = S.files(spark, d).select("relative_path", "language", "content", F.col("relative_path").alias("scope"), F.lit("document").alias("type"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))
    return chunk.split_chunks(f, 128, grounding=2).withColumn("digest", F.md5(F.col("content").cast("binary"))).drop("content")


@query("ck04_enriched_chunks", f"SELECT relative_path, start_line, md5(concat('// Scope: ', relative_path, chr(10), content)) AS digest FROM ({_CHUNK.format(size=16, step=12)}) z WHERE regexp_matches(content, '\\S')")
def ck04(spark, d):
    c = chunk.line_chunks(S.files(spark, d), 16, 12).withColumn("language", F.lit("en"))
    return chunk.enriched(c).select("relative_path", "start_line", F.md5(F.col("enriched").cast("binary")).alias("digest"))


@query("wn09_line_prefix_sums", "SELECT doc_id, i AS line, CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS i FROM documents) x")
def wn09(spark, d):
    from pyspark.sql import Window

    lines = S.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), F.sum(F.length("l") + 1).over(w).alias("upto"))


@query("jn13_chunk_definitions", f"SELECT relative_path, start_line, start_line % 2 = 1 AS defined FROM ({_CHUNK.format(size=16, step=13)}) z WHERE regexp_matches(content, '\\S')")
def jn13(spark, d):
    c = chunk.line_chunks(S.files(spark, d), 16, 13).select("relative_path", "start_line")
    defs = c.where("start_line % 2 = 1").withColumn("hit", F.lit(True))
    return c.join(defs, ["relative_path", "start_line"], "left").select("relative_path", "start_line", F.coalesce("hit", F.lit(False)).alias("defined"))


@query("flt13_chunk_routing", f"SELECT CASE WHEN t > 60 THEN 'split' WHEN t >= 20 THEN 'keep' ELSE 'drop' END AS route, count(*) AS n FROM (SELECT ceil(length(content) / 4.0) AS t FROM ({_CHUNK.format(size=16, step=12)}) z WHERE regexp_matches(content, '\\S')) x GROUP BY route")
def flt13(spark, d):
    c = chunk.line_chunks(S.files(spark, d), 16, 12)
    return c.groupBy(F.when(F.col("tokens") > 60, "split").when(F.col("tokens") >= 20, "keep").otherwise("drop").alias("route")).agg(F.count(F.lit(1)).alias("n"))


# ---- incremental maintenance

_DIFF = "SELECT relative_path, CASE WHEN m.hash IS NULL THEN 'new' WHEN f.hash IS NULL THEN 'deleted' WHEN f.hash <> m.hash THEN 'changed' ELSE 'unchanged' END AS state FROM v_files f FULL JOIN v_manifest m USING (relative_path)"


@query("inc01_manifest_diff", _DIFF)
def inc01(spark, d):
    return incremental.manifest_diff(S.files(spark, d), S.manifest(spark, d))


@query("inc02_plan_counts", f"SELECT CASE state WHEN 'new' THEN 'add' WHEN 'changed' THEN 'update' ELSE 'delete' END AS action, count(*) AS n FROM ({_DIFF}) x WHERE state <> 'unchanged' GROUP BY action")
def inc02(spark, d):
    p = incremental.plan(incremental.manifest_diff(S.files(spark, d), S.manifest(spark, d)))
    return p.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# Recursive: a file's stays one after the other. `at` orders what happens to a path.
_NET = """lg AS (SELECT DISTINCT * FROM v_commits), lk AS (SELECT *, CASE status WHEN 'R' THEN concat(seq, '|', old_path, '|', path) END AS link FROM lg),
 tc AS (SELECT path, seq, 1 AS kind, CAST(NULL AS VARCHAR) AS link, NULL AS o FROM lk WHERE status = 'A' UNION ALL SELECT path, seq, 2, NULL, NULL FROM lk WHERE status = 'M' UNION ALL SELECT path, seq, 0, NULL, NULL FROM lk WHERE status = 'D'
  UNION ALL SELECT path, seq, 1, link, old_path FROM lk WHERE status = 'R' UNION ALL SELECT old_path, seq, 0, link, old_path FROM lk WHERE status = 'R'),
 sg AS (SELECT *, sum(CASE kind WHEN 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq, kind, o ROWS UNBOUNDED PRECEDING) AS seg, row_number() OVER (PARTITION BY path ORDER BY seq, kind, o) AS pos FROM tc),
 st AS (SELECT path, seg, bool_or(kind = 1) AS born, arg_min(link, pos) FILTER (WHERE kind = 1) AS came, arg_min_null(link, pos) FILTER (WHERE kind = 0) AS gone_by, bool_or(kind = 0) OR seg < max(seg) OVER (PARTITION BY path) AS gone FROM sg GROUP BY path, seg),
 wk AS (SELECT path AS start, born, path, gone, gone_by FROM st WHERE came IS NULL OR came NOT IN (SELECT gone_by FROM st WHERE gone_by IS NOT NULL) UNION ALL SELECT wk.start, wk.born, n.path, n.gone, n.gone_by FROM wk JOIN st n ON n.came = wk.gone_by),
 net AS (SELECT CASE WHEN born THEN 'A' WHEN gone THEN 'D' WHEN start = path THEN 'M' ELSE 'R' END AS status, CASE WHEN gone THEN start ELSE path END AS path, CASE WHEN NOT born AND NOT gone AND start <> path THEN start END AS old_path FROM wk WHERE gone_by IS NULL AND NOT (born AND gone))"""
# The crawl has all documents and the files alive at the end (notes are no source files); the manifest, an earlier state of both.
_GIT = f"""{_NET}, now AS (SELECT relative_path FROM v_files UNION SELECT path FROM net WHERE status <> 'D' AND path NOT LIKE 'docs/%'),
 was AS (SELECT relative_path FROM v_manifest UNION SELECT coalesce(old_path, path) FROM net WHERE status <> 'A'),
 took AS (SELECT DISTINCT CASE status WHEN 'D' THEN path ELSE old_path END AS path FROM net WHERE status IN ('D', 'R')),
 came AS (SELECT path, arg_min(status, status) AS status, arg_min_null(old_path, status) AS old_path FROM net WHERE status <> 'D' AND path IN (SELECT relative_path FROM now) GROUP BY path),
 chg AS (SELECT coalesce(c.path, t.path) AS relative_path, CASE WHEN c.path IS NULL AND n.relative_path IS NULL THEN 'delete' WHEN t.path IS NOT NULL OR c.status = 'M' THEN 'update' ELSE 'add' END AS action,
  CASE WHEN c.path IS NULL AND n.relative_path IS NULL THEN 'deleted' WHEN t.path IS NOT NULL THEN 'replaced' WHEN c.status = 'M' THEN 'modified' WHEN c.status = 'R' THEN 'renamed' ELSE 'added' END AS reason, c.old_path FROM came c FULL JOIN took t ON c.path = t.path LEFT JOIN now n ON n.relative_path = coalesce(c.path, t.path)),
 plan AS (SELECT * FROM chg UNION ALL SELECT relative_path, 'add', 'catch_all', NULL FROM now WHERE relative_path NOT IN (SELECT relative_path FROM was) AND relative_path NOT IN (SELECT relative_path FROM chg))"""


def _net(spark, d):
    return incremental.net_changes(incremental.parse_name_status(S.commits(spark, d)))


def _git_state(spark, d):
    """net changes, the files as they are now, and the manifest of the state that was indexed."""
    net = written(_net(spark, d), "net-changes")
    text = lambda c, note: F.concat(F.lit("// "), c, F.lit(f"\n{note} of "), c, F.lit("\nexport function "), F.regexp_replace(c, "[^a-z0-9]+", "_"), F.lit("() {}"))
    alive = net.where("status <> 'D' and path not like 'docs/%'").select(F.col("path").alias("relative_path")).distinct()
    alive = alive.select("relative_path", F.lit("typescript").alias("language"), text(F.col("relative_path"), "body").alias("content"))
    before = net.where("status <> 'A' and path not like 'docs/%'").select(F.coalesce("old_path", "path").alias("relative_path")).distinct()
    before = before.select("relative_path", F.lit("typescript").alias("language"), text(F.col("relative_path"), "stale words").alias("content"))
    docs = S.files(spark, d)
    files = docs.select("relative_path", "language", "content", "hash").unionByName(alive.withColumn("hash", T.short_hash(F.col("content"))))
    old = S.manifest(spark, d).join(docs.select("relative_path", "language", "content"), "relative_path", "left")
    old = old.select("relative_path", "language", F.when(F.col("hash") == "stale", F.concat(F.lit("stale words\n"), "content")).otherwise(F.coalesce("content", F.lit("a file that went"))).alias("content"), "hash")
    return net, files, old.unionByName(before.withColumn("hash", T.short_hash(F.col("content"))))


@query("inc02b_net_changes", f"WITH RECURSIVE {_NET} SELECT status, path, old_path FROM net")
def inc02b(spark, d):
    return _net(spark, d)


@query("inc02c_git_plan", f"WITH RECURSIVE {_GIT} SELECT relative_path, action, reason, old_path FROM plan")
def inc02c(spark, d):
    net, files, old = _git_state(spark, d)
    return incremental.git_plan(files, old, net)


@query("inc02d_git_plan_stats", f"WITH RECURSIVE {_GIT}, c AS (SELECT count(*) FILTER (WHERE action = 'add' AND reason <> 'catch_all') AS added, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE reason = 'catch_all') AS caught, (SELECT count(*) FROM now) AS total FROM plan) SELECT *, total - added - updated - caught AS unchanged FROM c")
def inc02d(spark, d):
    net, files, old = _git_state(spark, d)
    return incremental.plan_stats(incremental.git_plan(files, old, net), files)


@query("inc03_full_plan", "SELECT relative_path, 'add' AS action FROM v_files")
def inc03(spark, d):
    return S.files(spark, d).select("relative_path", F.lit("add").alias("action"))


_COMMITTED = "SELECT relative_path AS path, CASE state WHEN 'new' THEN 'A' WHEN 'changed' THEN 'M' ELSE 'D' END AS status FROM (" + _DIFF + ") x WHERE state <> 'unchanged'"
_WORKING = "SELECT relative_path AS path, CASE doc_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'D' END AS status FROM v_files WHERE doc_id % 5 = 0"


def _changes(spark, d):
    p = incremental.plan(incremental.manifest_diff(S.files(spark, d), S.manifest(spark, d)))
    committed = p.select(F.col("relative_path").alias("path"), F.when(F.col("action") == "add", "A").when(F.col("action") == "update", "M").otherwise("D").alias("status"))
    working = S.files(spark, d).where("doc_id % 5 = 0").select(F.col("relative_path").alias("path"), F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("D")), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"))
    return committed, working


@query("inc04_merge_changes", f"SELECT path, CASE WHEN w.status IS NULL THEN c.status WHEN c.status = 'A' AND w.status = 'M' THEN 'A' ELSE w.status END AS status FROM ({_COMMITTED}) c FULL JOIN ({_WORKING}) w USING (path)")
def inc04(spark, d):
    return incremental.merge_changes(*_changes(spark, d))


@query("st02_first_wins", f"SELECT path, coalesce(w.status, c.status) AS status FROM ({_COMMITTED}) c FULL JOIN ({_WORKING}) w USING (path)")
def st02(spark, d):
    committed, working = _changes(spark, d)
    return incremental.first_wins(working, committed)


@query("src07_working_tree", f"SELECT path, coalesce(w.status, c.status) AS status FROM ({_WORKING}) w FULL JOIN ({_COMMITTED}) c USING (path)")
def src07(spark, d):
    committed, working = _changes(spark, d)
    return incremental.first_wins(working, committed)


@query("src06_name_status", "SELECT CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R' END AS status, relative_path AS path, CASE WHEN doc_id % 4 = 3 THEN concat('old/', relative_path) END AS old_path FROM v_files")
def src06(spark, d):
    line = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('A\\t', relative_path) WHEN 1 THEN concat('M\\t', relative_path) WHEN 2 THEN concat('D\\t', relative_path) ELSE concat('R95\\told/', relative_path, '\\t', relative_path) END")
    return incremental.parse_name_status(S.files(spark, d).select(line.alias("line")))


@query("inc05_apply_plan", "SELECT relative_path, hash FROM v_files")
def inc05(spark, d):
    files, old = S.files(spark, d), S.manifest(spark, d)
    actions = incremental.plan(incremental.manifest_diff(files, old))
    fresh = files.join(actions.where("action <> 'delete'").select("relative_path"), "relative_path", "left_semi").select("relative_path", "hash")
    return incremental.apply_plan(old, actions, fresh)


# The files as they are now, their chunks of 16 lines every 12, and what a search over those chunks finds.
_NOW = f"""{_NET}, nf AS (SELECT relative_path, content FROM v_files UNION ALL SELECT path, concat('// ', path, chr(10), 'body of ', path, chr(10), 'export function ', regexp_replace(path, '[^a-z0-9]+', '_', 'g'), '() {{}}') FROM (SELECT DISTINCT path FROM net WHERE status <> 'D' AND path NOT LIKE 'docs/%') y),
 ch AS (SELECT relative_path, start_line, end_line, content, substr(sha256(concat(relative_path, ':', start_line, ':', end_line, ':', content)), 1, 16) AS doc_id FROM ({_CHUNK.format(size=16, step=12).replace('v_files', 'nf')}) z WHERE regexp_matches(content, '\\S'))"""
_SEARCH = f"""{_NOW}, tok AS (SELECT doc_id, unnest({duck_tokens('content')}) AS term FROM ch), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len({duck_tokens('content')}) AS dl FROM ch), st2 AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 idf AS (SELECT term, ln(((SELECT n FROM st2) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term), {_Q}, bm AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM st2)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qn USING (term) JOIN dl USING (doc_id) GROUP BY ALL)"""


def _brought_up(spark, d):
    """An engine that published the earlier state and was brought up to date by the git-based plan."""
    from ..api import Engine

    net, files, old = _git_state(spark, d)
    files = written(files, "files-now")
    engine = Engine(written(old, "files-before"), max_tokens=64, embed=vector.embedder("hashing", 16), versions=Versions(spark, buckets=4))
    engine.update(files, incremental.git_plan(files, old, net).unionByName(incremental.plan(incremental.manifest_diff(S.files(spark, d), S.manifest(spark, d))).where("action <> 'add'").withColumns({"reason": F.lit("hash"), "old_path": F.lit(None).cast("string")})))
    return engine


@query("inc05b_published_after_plan", f"WITH RECURSIVE {_NOW}, tok AS (SELECT doc_id, unnest({duck_tokens('content')}) AS term FROM ch), tf AS (SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS dl FROM tok GROUP BY doc_id) SELECT doc_id, relative_path, start_line, coalesce(terms, 0) AS terms, coalesce(dl, 0) AS dl, 16 AS dims FROM ch LEFT JOIN tf USING (doc_id)")
def inc05b(spark, d):
    """Chunks, vectors, postings and lengths of the newest version, joined by chunk: none may lack its others."""
    v = _brought_up(spark, d).versions
    n = v.latest()
    terms = v.table("occurrences", n).select("doc_id", F.size("terms").cast("long").alias("terms"))
    rows = v.table("chunks", n).join(v.table("vectors", n).select("doc_id", F.size("vector").alias("dims")), "doc_id", "full_outer").join(v.table("lengths", n).select("doc_id", "dl"), "doc_id", "full_outer").join(terms, "doc_id", "full_outer")
    return rows.select("doc_id", "relative_path", "start_line", F.coalesce("terms", F.lit(0)).alias("terms"), "dl", "dims")


@query("inc05c_search_after_plan", f"WITH RECURSIVE {_SEARCH} SELECT query_id, rank, doc_id, relative_path, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm) x JOIN ch USING (doc_id) WHERE rank <= 10")
def inc05c(spark, d):
    return _brought_up(spark, d).search(_queries(spark, d), mode="keyword")


@query("tx07b_filtered_search", f"WITH RECURSIVE {_SEARCH} SELECT query_id, rank, doc_id, relative_path, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm JOIN ch USING (doc_id) WHERE regexp_matches(relative_path, '[.]es$') AND NOT regexp_matches(relative_path, '^src_?1')) x WHERE rank <= 10")
def tx07b(spark, d):
    """A rare language and a scope: the filters come before the ranking, so nothing that they leave is missing."""
    return _brought_up(spark, d).search(_queries(spark, d), mode="keyword", language="es", exclude=["src1*/**", "src_1*/**"])


@query("inc06_version_gate", "SELECT relative_path, 'add' AS action FROM v_files")
def inc06(spark, d):
    # Another version or root: the old manifest counts for nothing.
    files = S.files(spark, d)
    old = S.manifest(spark, d).where(F.lit("v1") == F.lit("v2"))
    return incremental.plan(incremental.manifest_diff(files, old))


@query("jn06_files_left_manifest", "SELECT f.relative_path FROM v_files f LEFT JOIN v_manifest m USING (relative_path) WHERE m.hash IS NULL OR m.hash <> f.hash")
def jn06(spark, d):
    m = S.manifest(spark, d).select("relative_path", F.col("hash").alias("was"))
    return S.files(spark, d).join(m, "relative_path", "left").where("was is null or was <> hash").select("relative_path")


@query("jn07_deleted", "SELECT relative_path FROM v_manifest WHERE relative_path NOT IN (SELECT relative_path FROM v_files)")
def jn07(spark, d):
    return S.manifest(spark, d).join(S.files(spark, d), "relative_path", "left_anti").select("relative_path")


@query("jn08_catch_all", "SELECT relative_path FROM v_files WHERE relative_path NOT IN (SELECT relative_path FROM v_manifest) AND doc_id % 20 <> 0")
def jn08(spark, d):
    f = S.files(spark, d)
    planned = f.where("doc_id % 20 = 0").select("relative_path")
    return f.join(S.manifest(spark, d), "relative_path", "left_anti").join(planned, "relative_path", "left_anti").select("relative_path")


@query("jn09_diff_in_files", f"SELECT path FROM ({_COMMITTED}) c WHERE path IN (SELECT relative_path FROM v_files)")
def jn09(spark, d):
    committed, _ = _changes(spark, d)
    return committed.join(S.files(spark, d), F.col("path") == F.col("relative_path"), "left_semi").select("path")


@query("st05_deleted_difference", "SELECT relative_path FROM v_manifest EXCEPT SELECT relative_path FROM v_files")
def st05(spark, d):
    return S.manifest(spark, d).select("relative_path").exceptAll(S.files(spark, d).select("relative_path"))


# ---- parsers and one-batch indexing


@query("ck08_docstrings", "SELECT doc_id, concat('Doc of ', doc_id) AS doc FROM documents")
def ck08(spark, d):
    code = F.format_string('def f():\n    """Doc of %s"""\n', F.col("doc_id"))
    return S.table(spark, d, "documents").select("doc_id", F.regexp_extract(code, '"{3}(.*?)"{3}', 1).alias("doc"))


@query("ck09_parse_once", "SELECT count(DISTINCT text) AS n FROM documents")
def ck09(spark, d):
    return S.files(spark, d).dropDuplicates(["hash"]).agg(F.count(F.lit(1)).alias("n"))


@query("vx05_index_batch", f"SELECT count(*) AS chunks, count(DISTINCT relative_path) AS files FROM ({_CHUNK.format(size=16, step=12)}) z WHERE regexp_matches(content, '\\S')")
def vx05(spark, d):
    from ..api import Engine

    return Engine(S.files(spark, d), max_tokens=64).index(force=True).chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("relative_path").alias("files"))


@query("sm03_rate_limiter", _limited(3, 7200))
def sm03(spark, d):
    from ..streaming.state import rate_limited

    return rate_limited(S.table(spark, d, "events"), most=3, seconds=7200)


@query("sm06_audit_append", "SELECT event_id FROM v_audit WHERE type = 'error'")
def sm06(spark, d):
    from ..sources.files import audit_round_trip

    return audit_round_trip(S.audit(spark, d).where("type = 'error'").select("event_id"), "event_id long")
