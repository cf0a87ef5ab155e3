"""Files as tables: crawl, ignore rules, languages; and the text sinks of logs and exports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.evaluation import running
from .shared import small, written

# File extensions and their languages.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".rs": "rust", ".go": "go",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
}


def language_of(extension: Column) -> Column:
    """The language of an extension in any case, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(extension))


def ignore_regex(lines: list[str]) -> str:
    """One regex for the rules of an ignore file: comments and blanks skip, a leading slash anchors, * stays in a part."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "#!":
            continue
        body = T.glob_regex(line.strip("/"))[1:-1]
        anchored = line.startswith("/") or "/" in line.strip("/")
        out.append(("^" if anchored else "(^|/)") + body + "(/|$)")
    return "|".join(out) or r"(?!)"


def ignored(path: Column, lines: list[str]) -> Column:
    return path.rlike(ignore_regex(lines))


def crawl(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """relative_path, language, hash, size, modified_at, content of the source files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(LANGUAGES) + "}").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").rpartition("://")[2]) + "/", "")
    out = raw.select(relative.alias("relative_path"), language_of(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).alias("language"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.col("content").cast("string").alias("content"))
    return out.where(~ignored(F.col("relative_path"), ignore)) if ignore else out


def audit_round_trip(events: DataFrame, schema: str) -> DataFrame:
    """The events written as JSON lines and read again; malformed lines are dropped."""
    text = written(events.select(F.to_json(F.struct("*")).alias("value")), "audit")
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.where("e is not null").select("e.*")


def append_audit(events: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Appends events as JSON lines; a file holds at most per_file of them."""
    events.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line a row, fields quoted where they need it."""
    return df.select(F.concat_ws(",", *[T.csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]).alias("line"))


# ---- a crawl that lists in parallel

FILE_SCHEMA = "relative_path string, language string, hash string, size long, modified_at timestamp, content string"


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes each row (relative_path, content) as a file below a folder that all executors see; the paths and sizes written.
    Lazy as all else: the files are there once the result is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (content or "").encode()
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["relative_path", "size"])

    return files.select("relative_path", "content").mapInArrow(run, "relative_path string, size long")


def _tree_source() -> type[DataSource]:
    # Inside a function, so that it is sent by value: the worker that plans the read may not have this package.
    class Part(InputPartition):
        def __init__(self, folders: list[str], files: list[str]):
            self.folders, self.files = folders, files

    class TreeReader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.root, self.parts = options["path"], int(options["parts"])
            self.skip, self.languages = re.compile(options["skip"]), json.loads(options["languages"])

        def _open(self):
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.root)
            return fs, store, base.rstrip("/")

        def _listed(self, folder: str) -> tuple[list[str], list]:
            """Folders, and files of known extensions, right below a folder, without what is ignored."""
            fs, store, base = self._open()
            folders, files = [], []
            for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                own = info.path[len(base) :].lstrip("/")
                if self.skip.search(own):
                    continue
                if info.type == fs.FileType.Directory:
                    folders.append(own)
                elif info.extension and f".{info.extension.lower()}" in self.languages:
                    files.append(info)
            return sorted(folders), sorted(files, key=lambda x: x.path)

        def partitions(self) -> list[Part]:
            """The tree is opened level by level until there are enough folders; each part lists the rest of its own."""
            _, _, base = self._open()
            level, loose = [""], []
            while level and len(level) < self.parts:
                below = [self._listed(f) for f in level]
                loose += [i.path[len(base) :].lstrip("/") for _, files in below for i in files]
                level = [f for folders, _ in below for f in folders]
            n = max(1, min(self.parts, len(level) + len(loose)))
            return [Part(level[i::n], loose[i::n]) for i in range(n)]

        def read(self, partition: Part):
            fs, store, base = self._open()

            def row(info):
                import datetime
                import hashlib

                with store.open_input_stream(info.path) as f:
                    data = f.read()
                at = info.mtime.astimezone(datetime.UTC).replace(tzinfo=None)
                return (info.path[len(base) :].lstrip("/"), self.languages[f".{info.extension.lower()}"], hashlib.sha256(data).hexdigest()[:16], len(data), at, data.decode("utf-8", "replace"))

            for path in partition.files:
                yield row(store.get_file_info(f"{base}/{path}"))
            todo = list(reversed(partition.folders))
            while todo:
                folders, files = self._listed(todo.pop())
                todo += reversed(folders)
                yield from map(row, files)

    class Tree(DataSource):
        @classmethod
        def name(cls) -> str:
            return "source_tree"

        def schema(self) -> str:
            return "relative_path string, language string, hash string, size long, modified_at timestamp_ntz, content string"

        def reader(self, schema):
            return TreeReader(self.options)

    return Tree


def crawled(spark: SparkSession, root: str, ignore: list[str] | None = None, parts: int = 64) -> DataFrame:
    """FILE_SCHEMA of the source files under a folder (a URI), listed and read in `parts` tasks. Ignored folders are not
    opened, so nothing below them is listed."""
    spark.dataSource.register(_tree_source())
    languages = json.dumps(LANGUAGES)
    return spark.read.format("source_tree").option("path", root).option("parts", str(parts)).option("skip", ignore_regex(ignore or [])).option("languages", languages).load()


# ---- logs that rotate by size, and exports


def rotated(lines: DataFrame, *order: str, most: int = 10 << 20, before: int = 0) -> DataFrame:
    """lines (`line` and others) with `file`: the number of the file that each goes to, a new one after each `most` bytes in
    the order given. Running byte totals over ranges, so no task sees all lines. before: bytes that are there already."""
    sized = lines.withColumn("_bytes", F.octet_length("line") + 1)
    upto = running(sized, F.col("_bytes"), *order, name="_upto")
    return upto.withColumn("file", F.floor((F.col("_upto") - F.col("_bytes") + before) / most).cast("long")).drop("_bytes", "_upto")


#: Files of a rotated log that share a folder, and bytes of them that are read at once.
FOLDER, CHUNK = 1000, 1 << 20


def _log_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size of a rotated log's files, listed folder by folder in tasks."""
    store, base = fs.FileSystem.from_uri(path)
    folders = sorted(i.path for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == fs.FileType.Directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = sorted((i.path, i.size) for i in own.get_file_info(fs.FileSelector(folder)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.int64()))], ["path", "size"])

    parts = max(1, min(len(folders), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(parts).mapInArrow(run, "path string, size long")


def append_rotated(lines: DataFrame, path: str, *order: str, most: int = 10 << 20) -> None:
    """Appends lines to a log (a URI) whose files hold about `most` bytes; what is there counts by its files' sizes. Each task
    writes the files of its ranges of the order, FOLDER of them in a folder; what an earlier run or another task puts into the
    same file lies beside it under another name. A task that is run again writes the same names again."""
    there = _log_files(lines.sparkSession, path).agg(F.sum("size")).first()[0] or 0
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        part, at, folder, out = TaskContext.get().partitionId(), None, None, None
        try:
            for b in batches:
                files, values = b.column(0), b.column(1).to_pylist()
                begins = [0, *(i for i, x in enumerate(pc.not_equal(files[1:], files[:-1]).to_pylist(), 1) if x)] if values else []
                for begin, end in zip(begins, [*begins[1:], len(values)], strict=False):
                    if (file := files[begin].as_py()) != at:
                        if out:
                            out.close()
                        if folder != (folder := f"{base}/{file // FOLDER:09}"):
                            store.create_dir(folder, recursive=True)
                        at, out = file, store.open_output_stream(f"{folder}/{file:012}-{name}-{part:06}")
                    out.write("".join(f"{x or ''}\n" for x in values[begin:end]).encode())
                yield pa.RecordBatch.from_arrays([pa.array([len(values)], pa.int64())], ["lines"])
        finally:
            if out:
                out.close()

    placed = rotated(lines, *order, most=most, before=there).sortWithinPartitions(*order)
    placed.select("file", "line").mapInArrow(run, "lines long").write.format("noop").mode("overwrite").save()


def read_rotated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`file` (its number as text, so files stand in name order) and the fields of each line that is well formed. Small files are
    read many in a task, large ones in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        files, values, size = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.string())], ["value", "file"])

        for b in batches:
            for one in b.column(0).to_pylist():
                number, rest = one.rpartition("/")[2].partition("-")[0], b""
                with store.open_input_stream(one) as f:
                    while chunk := f.read(CHUNK):
                        *whole, rest = (rest + chunk).split(b"\n")
                        values += [x.decode("utf-8", "replace") for x in whole]
                        files += [number] * len(whole)
                        if (size := size + len(chunk)) >= CHUNK:
                            yield block()
                            files, values, size = [], [], 0
                if rest:  # a line that was cut off
                    values.append(rest.decode("utf-8", "replace"))
                    files.append(number)
        yield block()

    dealt = _log_files(spark, path).select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = dealt.mapInArrow(run, "value string, file string")
    fields = StructType.fromDDL(schema)
    parsed = raw.select("file", F.from_json("value", StructType([*fields, StructField("_bad", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e is not null and e._bad is null").select("file", *[F.col("e").getField(f.name).alias(f.name) for f in fields])


def csv_export(records: DataFrame, *order: str, col: str = "json") -> DataFrame:
    """line_no and line of records (JSON objects in `col`): a header of all keys that any record has, in order of the
    alphabet, then one line a record; missing and null values are empty, objects and arrays stand as JSON. No records, no
    header. The keys are counted before they are broadcast."""
    keys = small(records.select(F.explode(F.json_object_keys(col)).alias("k")).distinct())
    header = keys.agg(F.array_sort(F.collect_set("k")).alias("_keys")).where(F.size("_keys") > 0)
    placed = running(records, F.lit(1), *order, name="line_no").withColumn("_m", F.from_json(col, "map<string,string>"))
    value = lambda k: T.csv_field(F.coalesce(F.try_element_at("_m", k), F.lit("")))
    rows = placed.crossJoin(F.broadcast(header)).select(F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform("_keys", value), ",").alias("line"))
    return header.select(F.lit(0).cast("long").alias("line_no"), F.array_join(F.transform("_keys", T.csv_field), ",").alias("line")).unionByName(rows)


# ---- ground truth in parts

#: The parts of a ground-truth dataset, each a folder of JSON lines; a dataset written whole has one file of them all.
TRUTH_PARTS = ("symbols", "call_graphs", "imports", "cycles", "metadata")


def save_truth(parts: dict[str, DataFrame], path: str) -> None:
    """Writes each known part; parts that are not given stay out."""
    unknown = set(parts) - set(TRUTH_PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_truth(spark: SparkSession, path: str, schemas: dict[str, str], defaults: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """The parts with these schemas; a part that was not written is empty. defaults: values of columns that a record lacks."""
    out = {}
    for name in TRUTH_PARTS:
        schema = schemas.get(name, "id string")
        try:
            df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/{name}")
        except AnalysisException:  # never written
            df = spark.createDataFrame([], schema)
        out[name] = df.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if defaults and c in defaults else F.col(c) for c in df.columns])
    return out
