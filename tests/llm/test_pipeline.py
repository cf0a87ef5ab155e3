"""The pipeline against a brute-force version of its stages, on odd rows."""

import hashlib
import re

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skarn.llm import bpe, langid, mixing, secrets
from skarn.llm.common import written

from .test_operators import ROWS, brute_components, docs, empty  # noqa: F401


def test_stage_contracts(spark, docs, empty):  # noqa: F811
    for start in (docs, empty):
        now = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = written(stage(spark, now, "unused"), name)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == start.columns, name
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(now.columns)


def test_against_brute_force(spark, docs):  # noqa: F811
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = out[name] = written(stage(spark, now, "unused"), name)
    first = {(r.doc_id, r.text) for r in out["language_id"].collect()}
    scored = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~langid.held_out()))).collect()
    assert first == {(r.doc_id, r.text) for r in scored if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    comp = brute_components(list(first))
    second = out["ngram_jaccard_join"].collect()
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == sorted(i for i, c in comp.items() if i == c)
    masked = {r.doc_id: r.text for r in out["secret_scans"].collect()}
    for r in second:
        spans = secrets.find(r.text or "")
        assert (masked[r.doc_id] != r.text) == bool(spans)
    plan = mixing.mix(mixing.sized(out["secret_scans"])).agg(F.sum("taken")).first()[0]
    mixed = out["mixing_sources"].collect()
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in mixed) == plan
    path, pattern = bpe.public_ranks()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((str(r.doc_id), len(ids := enc.encode_ordinary(r.text)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in mixed)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in out["byte_bpe"].collect()) == want


def test_rows_cover_the_odd_cases():
    assert {i for i, *_ in ROWS if [x[0] for x in ROWS].count(i) > 1} == {9} and any(t is None for _, t, _, _ in ROWS)
