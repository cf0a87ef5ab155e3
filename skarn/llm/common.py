"""What the operators share: reading tables, the shared folder, and bounded slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = "\x20\t\n\x0b\x0c\r"
#: Bytes of text that a worker turns into word arrays at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a folder of our own, on a local master
    only: on a cluster executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='skarn-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/skarn/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: cuts the lineage, and a lost executor can't lose it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, hot: int) -> DataFrame:
    """The keys that hold more than 1/hot of df's rows, so fewer than `hot` of them; null is none."""
    return written(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > df.count() / hot)).select(key), "hot-keys")


def by_key(left: DataFrame, right: DataFrame, key: str, hot: int, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """left (a written table) joined to right, which has a key once. What belongs to a hot key comes by a broadcast of fewer
    than `hot` rows, all else by a shuffle, so that no task gets a key's rows."""
    keys = hot_keys(left, key, hot) if keys is None else keys
    if keys.isEmpty():
        return left.join(right, key, how)
    keys = F.broadcast(keys)
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_semi").join(few, key, how).unionByName(left.join(keys, key, "left_anti").join(right, key, how))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes in `column`, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)


def tidy() -> None:
    """At the end of a task: gives freed memory back, as workers live on beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def extended(df: DataFrame, more: str, names: list[str] | None = None) -> StructType:
    """The schema of df, or of some of its columns, with further fields given as DDL."""
    kept = df.schema.fields if names is None else [f for f in df.schema.fields if f.name in names]
    return StructType([*kept, *StructType.fromDDL(more).fields])


def plain_text(column: pa.Array) -> pa.Array:
    """The column as a large_string array of its own, null as the empty text. Built anew: pc.ascii_lower misreads slices."""
    return pa.array([t or "" for t in column.to_pylist()], pa.large_string())
