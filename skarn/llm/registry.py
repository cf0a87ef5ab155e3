"""Queries and SQL of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fim, html, idstore, jaccard, langid, lexical, media, mixing, secrets, sharding, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html.op1_html_extraction,
        "op2_mixing_sources": mixing.op2_mixing_sources,
        "op3_token_id_output": idstore.op3_token_id_output,
        "op4_multi_index_hashing": ann.op4_multi_index_hashing,
        "op5_sampled_splitters": sharding.op5_sampled_splitters,
        "op6_language_id": langid.op6_language_id,
        "op7_media_columns": media.op7_media_columns,
        "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_url_filters": urls.op12_url_filters,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing_sources": mixing.ORACLE, "op5_sampled_splitters": sharding.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE,
            "op11_fill_in_middle": fim.ORACLE, "op12_url_filters": urls.ORACLE, "op13_lexical_search": lexical.ORACLE}
