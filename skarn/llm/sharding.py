"""Sharding by sampled splitters under the law `bytes`: sizes near equal. DataFrame and SQL functions only.

What is placed are units: all records of one text together, and single records of a text that is larger than a shard (fewer
than `shards` texts can be). Units are ordered by the hash of the text, then of the row. A size-weighted sample of their keys
gives quantile boundaries; units are range-partitioned by them, each range's bytes are counted exactly and overfull ranges are
subdivided. Running sizes over the pieces and inside each give every unit its place on the line of all bytes, and it goes to
the shard that its middle lies in: a border between shards moves to the nearer end of the unit that it would cut. So equal
texts stand together, and a shard differs from the mean by half of the units at its two borders at most.

A text of very many records is one unit; its records take the unit's shard by a broadcast of at most HOT keys, and slots are
counted over pieces of rows by hash, so no task gets a text's rows.

Defined cases: a null text is 8 bytes; repeated rows are records of their own; null ids sort as the empty string; ties of size
or text are told apart by the row's hash; an empty table gives an empty result; shards may stay empty where there are fewer
units than shards, or a unit covers a shard's whole share. Further columns are not carried: the result is one of records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, hot_keys, table, written
from .mixing import dialect

SHARDS = 24
#: Ranges before subdivision, and sampled keys for each of them.
RANGES, KEYS = 384, 16
#: Rows of a piece, about: a range of more units is subdivided, whatever its bytes, and a task orders one piece at a time.
PIECE_ROWS = 1 << 20
#: Texts that hold more than 1/HOT of the records are joined by broadcast.
HOT = 1024
SEED = 29

# Texts larger than a shard are torn; the units.
_UNITS = """texts AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS size FROM records GROUP BY key
), torn AS (
  SELECT key FROM texts WHERE size * {SHARDS} > (SELECT sum(size) FROM records)
), units AS (
  SELECT key, '' AS row_key, size FROM texts WHERE key NOT IN (SELECT key FROM torn)
  UNION ALL SELECT key, row_key, size FROM records WHERE key IN (SELECT key FROM torn)
)"""
_BOUNDS = """hits AS (
  SELECT concat(key, row_key) AS k, size * CAST({RANGES} * {KEYS} AS DOUBLE) / (SELECT sum(size) FROM units) AS x, {HASH(concat(key, row_key, ':{SEED}'))} / 1152921504606846976e0 AS u FROM units
), sample AS (
  SELECT k, row_number() OVER (ORDER BY k, i) AS place FROM (SELECT k, {SERIES(CAST(1 AS BIGINT), CAST(floor(x) + CASE WHEN u < x - floor(x) THEN 1 ELSE 0 END AS BIGINT))} AS i FROM hits WHERE x >= 1 OR u < x) y
), bounds AS (
  SELECT DISTINCT k AS bound FROM sample WHERE place % {KEYS} = 0
)"""
# rng: the range; sub: the piece of an overfull range; then running sizes over pieces and within each.
_PLACE = """counted AS (
  SELECT rng, CAST(sum(size) AS DOUBLE) AS bytes, count(*) AS n FROM ranged GROUP BY rng
), cut_up AS (
  SELECT rng, greatest(CAST(ceil(n / {PIECE_ROWS}.0e0) AS BIGINT), CASE WHEN bytes > 1.5e0 * (SELECT sum(bytes) FROM counted) / {RANGES} THEN CAST(ceil(bytes * {RANGES} / (SELECT sum(bytes) FROM counted)) AS BIGINT) ELSE 1 END) AS cuts FROM counted
), piece_rows AS (
  SELECT r.key, r.row_key, r.size, r.rng, {HASH(concat(r.key, r.row_key))} % c.cuts AS sub FROM ranged AS r JOIN cut_up AS c ON r.rng = c.rng
), piece AS (
  SELECT rng, sub, sum(sum(size)) OVER (ORDER BY rng, sub) - sum(size) AS before FROM piece_rows GROUP BY rng, sub
), placed AS (
  SELECT p.key, p.row_key, b.before + sum(p.size) OVER (PARTITION BY p.rng, p.sub ORDER BY p.key, p.row_key ROWS UNBOUNDED PRECEDING) - p.size / 2.0e0 AS mid
  FROM piece_rows AS p JOIN piece AS b ON p.rng = b.rng AND p.sub = b.sub
), put AS (
  SELECT key, row_key, CAST(least({SHARDS} - 1, floor(mid * {SHARDS} / (SELECT sum(size) FROM ranged))) AS BIGINT) AS shard FROM placed
)"""
_SLOT = """subbed AS (
  SELECT *, {HASH(concat(key, row_key, ':slot'))} % (SELECT CAST(greatest(1, ceil(count(*) / {PIECE_ROWS}.0e0)) AS BIGINT) FROM sharded) AS sub FROM sharded
), parts AS (
  SELECT shard, sub, sum(count(*)) OVER (PARTITION BY shard ORDER BY sub) - count(*) AS before FROM subbed GROUP BY shard, sub
) SELECT p.doc_id, p.size, p.text_crc32, 'bytes' AS law, CAST(p.shard AS INT) AS shard,
  CAST(b.before + row_number() OVER (PARTITION BY p.shard, p.sub ORDER BY p.key, p.row_key) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM subbed AS p JOIN parts AS b ON p.shard = b.shard AND p.sub = b.sub"""


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key (of the text) and row_key (of the row), written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.md5(text.cast("binary")), 1, 16).alias("key"))
    each = each.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    row = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"))), 1, 16)
    return written(each.select("doc_id", "size", "text_crc32", "key", row.alias("row_key")), "shard-records")


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards `records` rows: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = rows.sparkSession
    values = {"SHARDS": shards, "RANGES": RANGES, "KEYS": KEYS, "SEED": SEED, "PIECE_ROWS": PIECE_ROWS}

    def run(*parts: str, select: str = "", **tables: DataFrame) -> DataFrame:
        sql = dialect("WITH " + ", ".join(parts) + select, False, **values)
        for name in tables:
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
        return spark.sql(sql, **tables)

    units = written(run(_UNITS, select=" SELECT * FROM units", records=rows), "shard-units")
    # To the driver come about RANGES keys, whatever the input.
    bounds = [f"'{x[0]}'" for x in run(_BOUNDS, select=" SELECT bound FROM bounds ORDER BY bound", units=units).collect()]
    # Looked up in two steps: every 20th boundary, then those between.
    some = f"size(filter(array({', '.join(bounds[::20])}), b -> b <= concat(key, row_key)))"
    fine = f"size(filter(slice(array({', '.join(bounds)}), ({some} - 1) * 20 + 1, 20), b -> b <= concat(key, row_key)))"
    at = f"CASE WHEN {some} = 0 THEN 0 ELSE ({some} - 1) * 20 + {fine} END" if bounds else "0"
    ranged = written(units.selectExpr("key", "row_key", "size", f"CAST({at} AS INT) AS rng"), "shard-ranged")
    put = written(run(_PLACE, select=" SELECT * FROM put", ranged=ranged), "shard-put")
    whole, single = put.where("row_key = ''").drop("row_key"), put.where("row_key <> ''")
    torn = F.broadcast(single.select("key").distinct())  # fewer than `shards` rows
    together = by_key(rows.join(torn, "key", "left_anti"), whole, "key", HOT, keys=_hot(rows, torn))
    apart = rows.join(torn, "key", "left_semi").join(single, ["key", "row_key"])
    return run(_SLOT, sharded=written(together.unionByName(apart.select(together.columns)), "shard-rows"))


def _hot(rows: DataFrame, torn: DataFrame) -> DataFrame:
    return hot_keys(rows, "key", HOT).join(torn, "key", "left_anti")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(records(table(spark, sf_dir, "documents")))


# CRC-32 in SQL: the table from its rule, each text's bytes as a list, 200 hex digits at a time.
_CRC = """WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)) x
), hexed AS (
  SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents) x
), hexes AS (
  SELECT text, unnest(range(0, greatest(1, (length(h) + 199) // 200))) AS k, h FROM hexed
), listed AS (
  SELECT text, list_prepend(4294967295, flatten(list(list_transform(range(1, length(p) // 2 + 1), lambda i: CAST(concat('0x', substr(p, 2 * i - 1, 2)) AS BIGINT)) ORDER BY k))) AS bytes
  FROM (SELECT text, k, substr(h, 200 * k + 1, 200) AS p FROM hexes) x GROUP BY text
), crcs AS (
  SELECT text, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS crc FROM listed CROSS JOIN crc_table
)"""
ORACLE = dialect(", ".join([_CRC, """records AS (
  SELECT doc_id, size, text_crc32, key, substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(copy AS VARCHAR))), 1, 16) AS row_key FROM (
    SELECT doc_id, size, text_crc32, key, row_number() OVER (PARTITION BY doc_id, size, text_crc32, key) AS copy FROM (
      SELECT d.doc_id, CAST(strlen(c.text) + 8 AS BIGINT) AS size, CAST(c.crc AS BIGINT) AS text_crc32, substr(md5(c.text), 1, 16) AS key FROM documents d JOIN crcs c ON coalesce(d.text, '') = c.text) a) b
)""", _UNITS, _BOUNDS, "ranged AS (SELECT u.key, u.row_key, u.size, (SELECT count(*) FROM bounds b WHERE b.bound <= concat(u.key, u.row_key)) AS rng FROM units u)",
    _PLACE, "sharded AS (SELECT r.*, p.shard FROM records AS r JOIN put AS p ON r.key = p.key AND p.row_key IN ('', r.row_key))", _SLOT]), True, SHARDS=SHARDS, RANGES=RANGES, KEYS=KEYS, SEED=SEED, PIECE_ROWS=PIECE_ROWS)
