"""The engine's public surface: one object over tables, each method a lazy DataFrame.

    engine = Engine(files)                      # relative_path, language, content, hash, size
    engine.search(queries, mode="hybrid", ...)  # queries: query_id, query (and vector)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import analytics, chunk, graph, incremental, registries, search, vector
from .sources.shared import small, written
from .sources.versions import Versions

MODES = ("semantic", "keyword", "hybrid")
#: The tables of a published index; all but the last are replaced by file.
TABLES = ("chunks", "vectors", "occurrences", "lengths", "manifest", "frequencies")
KEY = "relative_path"


@dataclass
class Index:
    """What indexing gives: the chunks, postings and manifest rows of the files that it took in, and the published version."""

    chunks: DataFrame
    postings: DataFrame
    manifest: DataFrame
    version: int


class Engine:
    def __init__(self, files: DataFrame, manifest: DataFrame | None = None, embed=vector.hashing_embedding, max_tokens: int = 512, overlap: float = 0.25, versions: Versions | None = None):
        """versions: where the index is published; a folder of its own if it is not given."""
        self.files, self.manifest, self.embed = files, manifest, embed
        self.size, self.step = chunk.windows(max_tokens, overlap)
        self.versions = versions or Versions(files.sparkSession)

    # ---- indexing

    def plan(self, force: bool = False) -> DataFrame:
        """relative_path and action against the manifest that the engine was given, or the published one once it has indexed or
        was given none; everything is added anew with `force` or without a manifest."""
        old = self.manifest
        if old is None and self.versions.latest():
            old = self.versions.table("manifest")
        if force or old is None:
            return self.files.select("relative_path", F.lit("add").alias("action"))
        return incremental.plan(incremental.manifest_diff(self.files, old))

    def index(self, force: bool = False, plan: DataFrame | None = None) -> Index:
        """Brings the published index up to the files by a plan (relative_path, action), by default that of `plan`. Chunks,
        vectors, postings and the manifest of the planned files are replaced in one version; the first version, and any with
        `force`, holds all files."""
        todo = written((self.plan(force) if plan is None else plan).select("relative_path", "action"), "plan")
        added = todo.where("action <> 'delete'").select("relative_path")
        first = force or not self.versions.latest()
        fresh = self.files.join(small(added), "relative_path", "left_semi")
        tables = self._tables(self.files if first else fresh)
        if first:
            tables["frequencies"] = tables["occurrences"].select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            version = self.versions.publish(tables, {t: KEY for t in TABLES[:-1]})
        else:
            gone = todo.select(F.col("relative_path").alias("key"))
            lost = self.versions.table("occurrences").join(small(todo.select("relative_path")), KEY, "left_semi")
            of = lambda rows, n: rows.select(F.explode("terms").alias("term"), F.lit(n).cast("long").alias("df"))
            change = of(lost, -1).unionByName(of(tables["occurrences"], 1))
            sums = self.versions.table("frequencies").unionByName(change.groupBy("term").agg(F.sum("df").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
            version = self.versions.replace(gone, tables, {"frequencies": sums.where("df > 0")})
        self.manifest = None  # from here on the published one counts
        own = lambda name: self.versions.table(name, version).join(small(added), KEY, "left_semi")
        return Index(own("chunks").withColumnRenamed("doc_id", "chunk_id"), search.term_rows(own("occurrences")).select("doc_id", "term", "tf"), own("manifest").select("relative_path", "hash", "chunk_count"), version)

    def update(self, files: DataFrame, plan: DataFrame | None = None) -> Index:
        """Takes the files as they are now and brings the index up to them."""
        self._stored()
        self.files = files
        return self.index(plan=plan)

    def _tables(self, files: DataFrame) -> dict[str, DataFrame]:
        """The tables of some files. The large ones are written once, where the version will name them."""
        put = lambda name, df: self.versions.staged(name, df, KEY)
        docs = put("chunks", self.chunks(files).withColumnRenamed("chunk_id", "doc_id"))
        occurrences = put("occurrences", search.occurrences_of(docs, "doc_id", "content", KEY))
        counts = docs.groupBy(KEY).agg(F.count(F.lit(1)).alias("chunk_count"))
        return {
            "chunks": docs,
            "vectors": put("vectors", self.embed(docs.select("doc_id", KEY, F.col("content").alias("text"))).select("doc_id", KEY, "vector")),
            "occurrences": occurrences,
            "lengths": search.lengths_of(occurrences),
            "manifest": files.select(KEY, "hash").join(counts, KEY, "left").select(KEY, "hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")),
        }

    def _stored(self) -> int:
        """The newest version; all files are published if there is none."""
        if self.versions.latest() is None:
            given = self.manifest
            self.index(force=True)
            self.manifest = given
        return self.versions.latest()

    def chunks(self, files: DataFrame | None = None) -> DataFrame:
        """chunk_id, relative_path, language, start_line, end_line, content, tokens."""
        from .functions import text as T

        own = files if files is not None else self.files
        lines = chunk.line_chunks(own, self.size, self.step, "language")
        return lines.withColumn("chunk_id", T.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content")))

    # ---- retrieval

    def search(self, queries: DataFrame, *, mode: str = "hybrid", limit: int = 10, language: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, ranking: bool = False, compat: bool = False) -> DataFrame:
        """query_id, rank, doc_id (chunk), relative_path, score. Reads the newest published version; filters hold before
        anything is ranked (with `compat`, as search.search says)."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        at = self._stored()
        docs = self.versions.table("chunks", at)
        filtered = bool(language or include or exclude) and not compat
        within = written(search.allowed(docs, language, include, exclude), "allowed") if filtered else None
        wide = limit * (2 if ranking else 1) * (3 if compat and (include or exclude) else 1) * 3
        semantic = keyword = None
        if mode != "keyword":
            vectors = self.versions.table("vectors", at)
            if within is not None:
                vectors = vectors.join(within, "doc_id", "left_semi")
            elif compat and language:
                vectors = vectors.join(search.allowed(docs, language), "doc_id", "left_semi")
            asked = self.embed(queries.select("query_id", F.col("query").alias("text")), prefix="search_query: ").select("query_id", "vector")
            semantic = vector.knn(vectors, asked, wide)
        if mode != "semantic":
            keyword = search.bm25_of(self._text_index(at), queries, wide, within=within)
        return search.search(docs, semantic, keyword, limit, include=include if compat else None, exclude=exclude if compat else None, ranking=ranking, language=language if compat else None, compat=compat)

    def _text_index(self, at: int) -> search.TextIndex:
        lengths = self.versions.table("lengths", at)
        stats = search.corpus_stats(lengths)
        return search.TextIndex(self.versions.table("occurrences", at), lengths, search.idf_of(self.versions.table("frequencies", at), stats), stats)

    def symbols(self, symbols: DataFrame, queries: DataFrame, *, threshold: float = 0.4, types: list[str] | None = None, limit: int = 10) -> DataFrame:
        from .functions import text as T

        return search.fuzzy(symbols, queries, limit, threshold, types).withColumn("score", T.round_half_up(F.col("score")))

    def context(self, symbol: str, around: int = 5) -> DataFrame:
        return search.context(self.files, symbol, around)

    def references(self) -> tuple[DataFrame, DataFrame]:
        """Definitions and call sites of the files, as `xrefs` and `find_symbol` take them, by the strategy of each language."""
        return registries.references(self.files)

    def xrefs(self, definitions: DataFrame, sites: DataFrame, symbol: str, direction: str = "callers", limit: int = 20) -> DataFrame:
        """Distinct callers of a symbol, or what it calls. definitions: fqn, name; sites: name, caller."""
        names = graph.symbol_matches(definitions, symbol).select(F.substring_index("fqn", ".", -1).alias("_n")).distinct()
        if direction == "callers":
            return sites.join(names, sites["name"] == names["_n"], "left_semi").select("caller").distinct().orderBy("caller").limit(limit)
        return sites.join(names, sites["caller"] == names["_n"], "left_semi").select("name").distinct().orderBy("name").limit(limit)

    # ---- graphs

    def dependencies(self, edges: DataFrame, entry_points: list[str], max_depth: int = 50) -> DataFrame:
        starts = edges.sparkSession.createDataFrame([(e,) for e in entry_points], "node string")
        return graph.closure(edges, starts, max_depth)

    def cycles(self, edges: DataFrame, max_length: int | None = None) -> DataFrame:
        return graph.cycles(edges, max_length)

    def find_symbol(self, definitions: DataFrame, name: str) -> DataFrame:
        return graph.symbol_matches(definitions, name)

    def summarize(self, edges: DataFrame, budget: int = 4000) -> DataFrame:
        """One row: files, tokens, languages, roots, whether the files exceed the token budget."""
        from .functions import text as T

        own = self.files.agg(F.count(F.lit(1)).alias("files"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"), F.countDistinct("language").alias("languages"))
        roots = graph.roots(edges).agg(F.count(F.lit(1)).alias("roots"))
        return own.crossJoin(roots).withColumn("over_budget", F.col("tokens") > budget)

    # ---- records

    def stats(self) -> DataFrame:
        """Files and size by language, and their totals."""
        return self.files.rollup("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))

    def query_analytics(self, log: DataFrame, patterns: int = 20) -> tuple[DataFrame, DataFrame]:
        return analytics.query_totals(log), analytics.patterns(log, patterns)

    def token_analytics(self, records: DataFrame, *by: str) -> DataFrame:
        return analytics.token_savings(records, *by)

    def memory_profile(self, samples: DataFrame, every: int = 5) -> DataFrame:
        return analytics.samples(samples, every)


class Tasks:
    """Tasks as an append-only change log (id, parent_id, label, status, seq); each method gives the new log or a view."""

    def __init__(self, log: DataFrame):
        self.log = log

    def current(self) -> DataFrame:
        return analytics.latest(self.log, "id", "seq").where("status <> 'deleted'")

    def update(self, changes: DataFrame) -> Tasks:
        """Appends rows (id, status) for tasks that exist; others are ignored."""
        now = self.current().drop("status").join(changes.select("id", "status"), "id")
        return Tasks(self.log.unionByName(now.withColumn("seq", F.col("seq") + 1).select(self.log.columns)))

    def spawn(self, rows: DataFrame) -> tuple[Tasks, DataFrame]:
        """Appends pending tasks (id, parent_id, label) whose parent exists, or is spawned with them, and the rows refused: those
        of an unknown parent, those below one, and ids that are there already or stand there twice."""
        own = written(rows.select("id", "parent_id", "label"), "spawned")
        known = self.current().select("id")
        fresh = own.join(known, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("parent_id").alias("parent_id"), F.first("label").alias("label")).where("_n = 1").drop("_n")
        fresh = written(fresh, "spawned")
        starts = fresh.where("parent_id is null").select("id").unionByName(fresh.join(known.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id"))
        below = graph.closure(fresh.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), starts.select(F.col("id").alias("node")))
        ok = fresh.join(below.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        log = ok.withColumns({"status": F.lit("pending"), "seq": F.lit(0).cast(self.log.schema["seq"].dataType)})
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.log.schema if f.name not in log.columns]
        return Tasks(self.log.unionByName(log.select("*", *more))), own.join(ok.select("id"), "id", "left_anti")

    def delete(self, ids: DataFrame, cascade: bool = False) -> Tasks:
        now = self.current()
        gone = ids.select("id")
        if cascade:
            kept = graph.cascade_delete(now, gone)
            gone = now.select("id").join(kept.select("id"), "id", "left_anti")
        return self.update(gone.withColumn("status", F.lit("deleted")))

    def tree(self) -> DataFrame:
        return graph.tree(self.current())

    def crashed(self) -> Tasks:
        """Running tasks fail."""
        return self.update(self.current().where("status = 'running'").select("id", F.lit("failed").alias("status")))

    def counts(self) -> DataFrame:
        return self.current().groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def newest(self, n: int) -> DataFrame:
        return self.current().withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("seq"), "id"))).where(F.col("_rn") <= n).drop("_rn")


class ToolCache:
    """Outputs of tools by task, stored in versions: a put replaces the outputs of its (task, tool) pairs and no others."""

    SCHEMA = "key string, task string, tool string, output string, cached_at long"

    def __init__(self, versions: Versions):
        self.versions = versions
        if versions.latest() is None:
            versions.publish({"outputs": versions.spark.createDataFrame([], self.SCHEMA)}, {"outputs": "key"})

    @staticmethod
    def _key() -> F.Column:
        return F.concat(F.length("task").cast("string"), F.lit(":"), "task", "tool")

    def put(self, rows: DataFrame) -> int:
        """rows: task, tool, output, cached_at; of one pair the newest counts. The version with them."""
        keyed = rows.select(self._key().alias("key"), "task", "tool", "output", F.col("cached_at").cast("long").alias("cached_at")).where("key is not null")
        last = keyed.groupBy("key").agg(F.max_by(F.struct("task", "tool", "output", "cached_at"), F.struct("cached_at", "output")).alias("r")).select("key", "r.*")
        return self.versions.replace(last.select("key"), {"outputs": last})

    def get(self, asked: DataFrame) -> DataFrame:
        """asked (task, tool) with output, cached_at and hit."""
        found = self.versions.table("outputs").select("task", "tool", "output", "cached_at", F.lit(True).alias("hit"))
        return asked.select("task", "tool").join(found, ["task", "tool"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def clear(self, tasks: DataFrame) -> int:
        """Without the outputs of these tasks (task)."""
        gone = self.versions.table("outputs").join(tasks.select("task"), "task", "left_semi").select("key")
        return self.versions.replace(gone, {"outputs": self.versions.spark.createDataFrame([], self.SCHEMA)})
