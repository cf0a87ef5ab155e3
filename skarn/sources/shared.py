"""Written intermediate tables in the shared folder, for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a side may be broadcast.
SMALL = 100_000


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder: spark.checkpoint.dir, or one of our own where that is unset, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='skarn-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/skarn/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bucket(df: DataFrame, key: str) -> DataFrame:
    """df with the rows of a bucket in one partition."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """df as a table bucketed by a key: what groups or joins by it later needs no shuffle."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, what)
    name = "skarn_" + path.rpartition("/")[2].replace("-", "_")
    by_bucket(df, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df to be broadcast where it is counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as can run at once, where it comes in fewer: for costly work on few bytes. Large inputs stay as
    they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
