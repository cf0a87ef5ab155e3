"""The pipeline over `documents`: five of the operators in turn, each stage written and read again.

1 language ID: documents that are `und` or scored below MIN_SCORE go; a missing lang is filled in.
2 n-gram Jaccard join: the document of the smallest doc_id of each component stays, with all texts that it has.
3 secret scans: spans that look like live credentials are masked, copied examples stay.
4 mixing: documents are repeated or drawn in part, so that each source comes near its target.
5 byte-level BPE: token counts and digests of what is left.

All stages but the last return the columns of documents, further ones too, whatever their names. n_chars follows the text. Rows
with a null doc_id pass the join as they are; an empty table gives empty results from stage to stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe, jaccard, langid, mixing, secrets
from skarn.llm.common import written
from skarn.session import ship

#: Below this score a language is not trusted. Only texts that mix languages evenly come near it.
MIN_SCORE = 0.5


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and any others in one struct, so that no name of theirs meets one of a stage."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    return docs.select(*COLUMNS, *[F.struct(*extra).alias("_extra")] * bool(extra))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select([F.col(c) if c in COLUMNS else F.col("_extra").getField(c).alias(c) for c in docs.columns])


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(_packed(docs), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return _unpacked(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def _one_of_equal_rows(docs: DataFrame) -> DataFrame:
    """One row of those of one doc_id and text, the least as JSON. Rows of one doc_id with other texts stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = written(jaccard.join(docs), "pipeline-join")
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = _one_of_equal_rows(kept)
    return kept.unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    scanned = written(secrets.scan(_packed(docs)), "pipeline-secrets")
    return _unpacked(_counted(secrets.redact(secrets.classified(scanned, "doc_id", "source"))), docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(_counted(mixing.mixed(_packed(docs))), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_decode(docs, *bpe.public_ranks())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: The join and the encoding are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
