"""Secret scans with corpus-wide ownership frequency.

Every base finding stays a finding. Over the whole corpus each candidate's hash is counted by distinct repositories and
distinct owners: a value that many of the corpus's owners carry, or that several owners carry in many of its repositories, is a
copied example; others, and all of one owner alone, look like a live credential. The method adds the spans of two kinds where they
look live: tokens in a provider's format, and bare tokens that are a finding's value anywhere in the corpus.

Defined cases: a null text reads as empty; an unknown (null) owner or repository counts as one owner or repository of its
own; equal rows count once; an empty table gives an empty result; further columns are carried, but for those named like a
result (found, spans).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, slices, table, tidy, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which they stand at the same place. The last two are those that the method adds.
KINDS = ("assign", "access", "hex", "provider", "bare")
# Public token formats of providers.
PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: A value is a copied example from so many distinct owners on, and from this share of the corpus's owners on.
COPIED_OWNERS, OWNERS_SHARE = 5, 0.01
#: The same for distinct repositories, where a value is not of one owner alone.
COPIED_REPOS, REPOS_SHARE = 20, 0.0001
#: A bare token has so many characters, with a digit and a letter among them.
BARE = 12
_DIGITS = re.compile(r"[0-9]+")
_BARE_RIGHT = re.compile(r"[A-Za-z0-9+/_.-]*={0,2}")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
_LETTER = re.compile(r"[A-Za-z]")
#: A list of candidates in over this share of the rows with any is joined by broadcast: there are fewer than 1 / HOT of them.
HOT = 0.001


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates by start, then kind; code points, end exclusive."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    found += [("provider", m.start(), m.end(), m[0]) for m in PROVIDER.finditer(text)]
    found += bare(text, found)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def bare(text: str, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Tokens of BARE characters or more around a digit, that overlap with nothing found. Prose has few digits, so each is
    widened to its token."""
    out, end = [], 0
    taken = sorted((s, e) for _, s, e, _ in found)
    upto = list(itertools.accumulate((e for _, e in taken), max))
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and (c := text[start - 1]) in _TOKEN_CHARS:
            start -= 1
        end = _BARE_RIGHT.match(text, m.start()).end()
        last = end - 1 if text[end - 1] == "." else end  # the end of a sentence
        if last - start >= BARE and _LETTER.search(text, start, last):
            k = bisect.bisect_left(taken, (last,))  # those that start before its end
            if not k or upto[k - 1] <= start:
                out.append(("bare", start, last, text[start:last]))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("hash", pa.string())]))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All of df's columns and `found`: array of (kind, s, e, hash of the value). One pass, no shuffle. A column of df
    named found or spans goes."""
    names = [c for c in df.columns if c.lower() not in ("found", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                rows = [[{"kind": k, "s": s, "e": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in find(t or "")] for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(rows, _FOUND)], [*names, "found"])
        tidy()

    return df.mapInArrow(run, extended(df, "found array<struct<kind:string,s:bigint,e:bigint,hash:string>>", names))


def ownership(found: DataFrame, repo: str, owner: str) -> DataFrame:
    """hash, n_repos, n_owners, n_base (rows where it is a base finding's value) over the whole corpus. Distinct triples
    first, then partial sums: a value that a third of all rows hold is pre-aggregated in each task before it is shuffled."""
    each = found.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode("found").alias("x")).select("repo", "owner", "x.hash", (F.col("x.kind") != "bare").cast("int").alias("base"))
    pairs = each.groupBy("hash", "owner", "repo").agg(F.max("base").alias("base"))
    repos = pairs.groupBy("hash", "repo").agg(F.max("base").alias("base")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("base").alias("n_base"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def classified(
    scanned: DataFrame, repo: str, owner: str, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, owners_share: float = OWNERS_SHARE, repos_share: float = REPOS_SHARE
) -> DataFrame:
    """scanned (a written table) with `spans`: array of (kind, s, e, live), those that the method adds only where they look
    live. Rows without candidates take no part in the join. The counts are attached to each distinct list of candidate hashes,
    so repeated documents are joined once; lists that many rows share are few, and a broadcast."""
    packed = scanned.select(F.struct(*[F.col(f"`{c}`") for c in scanned.columns if c != "found"]).alias("row"), "found")
    some = packed.where(F.size("found") > 0).withColumn("list", F.sha2(F.array_join(F.transform("found", lambda x: F.concat_ws(":", x.hash, x.kind)), ","), 256))
    # Two numbers of the corpus: its owners and its repositories, an unknown one among them.
    n_owners = scanned.select(owner).distinct().count()
    n_repos = scanned.select(repo).distinct().count()
    counts = ownership(scanned, repo, owner)
    lists = some.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.first("found.hash").alias("hashes"))
    one = lists.select("list", "n", F.explode(F.array_distinct("hashes")).alias("hash"))
    many_owners, many_repos = max(copied_owners, owners_share * n_owners), max(copied_repos, repos_share * n_repos)
    live = (F.col("n_owners") < many_owners) & ((F.col("n_owners") == 1) | (F.col("n_repos") < many_repos))
    each = F.struct("hash", F.struct(live.alias("live"), (F.col("n_base") > 0).alias("base")).alias("is"))
    known = written(one.join(counts, "hash").groupBy("list", "n").agg(F.map_from_entries(F.collect_list(each)).alias("known")), "secrets-lists")
    hot = known.where(F.col("n") > HOT * some.count()).drop("n")
    attached = some.join(F.broadcast(hot), "list").unionByName(some.join(F.broadcast(hot.select("list")), "list", "left_anti").join(known.drop("n"), "list"))
    at = lambda x: F.element_at("known", x.hash)
    kept = F.filter("found", lambda x: (x.kind != "provider") & (x.kind != "bare") | at(x)["live"] & at(x)["base"])
    spans = F.transform(kept, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"), at(x)["live"].alias("live")))
    empty = F.array().cast("array<struct<kind:string,s:bigint,e:bigint,live:boolean>>")
    return attached.select("row.*", spans.alias("spans")).unionByName(packed.where(F.size("found") == 0).select("row.*", empty.alias("spans")))


def redact(classed: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replaces each live span (merged where they overlap) by the mask; copied examples stay. Drops `spans`."""
    live = F.filter("spans", lambda x: x.live)
    # Spans come by start; the state is (text so far, end of the last mask).
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, x: F.substring(F.col(text_col), (a.at + 1).cast("int"), (F.greatest(x.s - a.at, F.lit(0))).cast("int"))
    step = lambda a, x: F.struct(F.when(x.s >= a.at, F.concat(a.out, piece(a, x), F.lit(mask))).otherwise(a.out).alias("out"), F.greatest(a.at, x.e).alias("at"))
    end = lambda a: F.concat(a.out, F.substring(F.col(text_col), (a.at + 1).cast("int"), F.lit(2**31 - 1)))
    return classed.withColumn(text_col, F.when(F.size(live) > 0, F.aggregate(live, zero, step, end)).otherwise(F.col(text_col))).drop("spans")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scanned = written(scan(docs).drop("text"), "secrets")
    out = classified(scanned, "doc_id", "source")
    base = F.filter("spans", lambda x: x.kind.isin("assign", "access", "hex"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x.live)).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x.live)).cast("long").alias("n_copied"),
    )
