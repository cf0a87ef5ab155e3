"""Several tables published together: a reader sees a version whole or not at all.

Rows lie in buckets of their key. A version is a list of folders, one for each table and bucket that has rows. Publishing
writes data first and the list last, in one file, which is what commits it; a run that ends before leaves folders that no
version names. Replacing the rows of some keys rewrites only the buckets of those keys; the new version names the old folders
of all others. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import scratch, small

MANIFEST = "version long, name string, bucket int, path string, schema string, key string"


class Versions:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 16):
        """root: a folder that all executors see; one of our own in the shared folder if it is not given."""
        self.spark, self.buckets = spark, buckets
        self.root = (root or scratch(spark, "versions")).rstrip("/")
        self._known: dict[int, list] = {}  # a version never changes
        self._staged: list[tuple[DataFrame, list[tuple]]] = []

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException:  # nothing is published yet
            return None

    def latest(self) -> int | None:
        """The newest version, None before the first."""
        rows = self._manifest()
        return rows.agg(F.max("version")).first()[0] if rows is not None else None

    def _entries(self, version: int | None) -> list:
        """The list of a version: at most tables x buckets rows."""
        version = self.latest() if version is None else version
        if version is None:
            raise LookupError(f"nothing is published under {self.root}")
        if version not in self._known:
            found = self._manifest().where(F.col("version") == version).collect()
            if not found:
                raise LookupError(f"version {version} is not published under {self.root}")
            self._known[version] = found
        return self._known[version]

    def names(self, version: int | None = None) -> list[str]:
        return sorted({r.name for r in self._entries(version)})

    def table(self, name: str, version: int | None = None) -> DataFrame:
        rows = [r for r in self._entries(version) if r.name == name]
        if not rows:
            raise LookupError(f"no table {name}")
        schema, paths = StructType.fromJson(json.loads(rows[0].schema)), [r.path for r in rows if r.path]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, df: DataFrame, key: str | None) -> list[tuple]:
        """Entries (name, bucket, path, schema, key) of a table's rows, which each task writes as it has them: no shuffle."""
        if (own := self._of(df)) is not None:
            return own
        schema = StructType([f for f in df.schema.fields])
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self._bucket(key) if key else F.lit(0))
        rows.write.partitionBy("_bucket").parquet(path)
        found = [r[0] for r in self.spark.read.schema("_bucket int").parquet(path).distinct().collect()]
        own = [(name, b, f"{path}/_bucket={b}", json.dumps(schema.jsonValue()), key) for b in found]
        return own or [(name, -1, None, json.dumps(schema.jsonValue()), key)]

    def _of(self, df: DataFrame) -> list[tuple] | None:
        return next((entries for own, entries in self._staged if own is df), None)

    def staged(self, name: str, df: DataFrame, key: str | None) -> DataFrame:
        """df, written where a version will name it. What is derived from it reads those rows, and publishing them under that
        name and key writes none again."""
        entries = self._written(name, df, key)
        paths = [e[2] for e in entries if e[2]]
        out = self.spark.read.schema(df.schema).parquet(*paths) if paths else self.spark.createDataFrame([], df.schema)
        self._staged.append((out, entries))
        return out

    def _commit(self, entries: list[tuple]) -> int:
        version = (self.latest() or 0) + 1
        rows = self.spark.createDataFrame([(version, *e) for e in entries], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self._staged.clear()
        return version

    def publish(self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> int:
        """A version with these tables alone. keys: the column whose rows are replaced together; a table without one is
        replaced whole."""
        return self._commit([e for n, df in tables.items() for e in self._written(n, df, (keys or {}).get(n))])

    def replace(self, gone: DataFrame, fresh: dict[str, DataFrame], whole: dict[str, DataFrame] | None = None) -> int:
        """A version in which each table of `fresh` has lost the rows whose key is in `gone` (one column, `key`) or in its
        fresh rows, and has gained those; tables of `whole` are given anew; all others stay as they are."""
        entries, whole = self._entries(None), whole or {}
        out = [tuple(e)[1:] for e in entries if e.name not in fresh and e.name not in whole]
        for name, df in fresh.items():
            own = [e for e in entries if e.name == name]
            key, schema = own[0].key, own[0].schema
            if [f.name for f in df.schema] != StructType.fromJson(json.loads(schema)).names:
                raise ValueError(f"the columns of {name} differ from those published")
            keys = gone.select(F.col("key").cast("string").alias("_key")).unionByName(df.select(F.col(key).cast("string").alias("_key"))).distinct()
            touched = {r[0] for r in keys.select(F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int")).distinct().collect()}
            old = [e.path for e in own if e.path and e.bucket in touched]
            kept = df.limit(0)
            if old:
                before = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*old)
                kept = before.join(small(keys), before[key].cast("string") == keys["_key"], "left_anti")
            out += [tuple(e)[1:] for e in own if e.bucket not in touched and e.path]
            done = self._of(df)
            new = self._written(name, kept.unionByName(df), key) if done is None else done + self._written(name, kept, key)
            named = any(e.bucket not in touched and e.path for e in own) or any(e[2] for e in new)
            out += [e for e in new if e[2]] or ([] if named else new[:1])
        out += [e for n, df in whole.items() for e in self._written(n, df, next((e.key for e in entries if e.name == n), None))]
        return self._commit(out)

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes the folders that none of the newest `keep` versions names; returns them. Their versions can't be read any
        more."""
        rows = self._manifest()
        newest = sorted((r[0] for r in rows.select("version").distinct().collect()), reverse=True)
        live = {r.path for v in newest[:keep] for r in self._entries(v)}
        dead = sorted({r.path for r in rows.select("path").distinct().collect() if r.path} - live)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in dead:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        return dead
