"""Ranked lexical search over documents reordered by recursive graph bisection.

The graph joins documents and their terms. Bisection splits documents into halves and swaps those that gain most, where a
term's cost in a half is that of the gaps between its documents there, and goes on inside the halves, so documents that share
terms come to stand together. The first levels are fitted on a bounded sample (SAMPLE documents, terms hashed to FEATURES) and
every document takes the side that its terms cost less on; the leaves, cut into pieces of bounded size, are bisected to the end
with all their documents and terms. CLUSTER documents next to each other are a cluster, one row of the index: its terms, their
postings as impacts, and each term's largest impact.

A query's bound for a cluster is the sum of its terms' weights times those largest impacts. The clusters of the best bounds are
scored first and give each query a threshold that its tenth score reaches at least. Then every task visits its clusters by
bound, and a query leaves out those whose bound is below its threshold, which rises as documents are found. That is exact: a
cluster left out holds no document that reaches the tenth score, and equal scores are still seen. Positions are mapped back to
doc_id, so ties go to the smaller doc_id whatever the order.

All of a text is read, in blocks, and no document or term is left out. Models, queries (BLOCK items at a time), thresholds and
results are the only things that pass through the driver, all bounded.

Defined cases: a null text and one without terms is no document of the corpus; rows of one doc_id are documents of their own;
a null doc_id stands last among equal scores; rows of one item_id are one item with the terms of all of them, and a null
item_id is an item too; items without known terms have no rows; empty tables give an empty result. Further columns are not
carried, as the result is pairs.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, tidy, written

#: Documents that the first levels are fitted on, features that their terms are hashed to, and the levels at most.
SAMPLE, FEATURES, LEVELS = 8192, 8192, 7
#: Documents, and bytes of distinct terms, of a piece; documents of a cluster.
PIECE_DOCS, PIECE_BYTES, CLUSTER = 4096, 12 << 20, 64
#: Rounds of swaps at most in a bisection.
ROUNDS = 6
#: Items searched together, and parts of the index that give each of them a cluster for its first threshold.
BLOCK, FIRST = 512, 4
#: Bytes of a text that are split into terms at once.
PART = 1 << 20
#: Fixed value: what a term is made of; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def term_counts(text: str) -> Counter[bytes]:
    """Occurrences of each term, as UTF-8. A term is bytes between bytes that are none, so a text can be cut at any of those."""
    data = text.encode().translate(_BYTES)
    if len(data) <= PART:
        return Counter(data.split())
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        to = data.find(b" ", at + PART)
        to = len(data) if to < 0 else to
        out.update(data[at:to].split())
        at = to
    return out


def features(terms: Iterable[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.int64) & (FEATURES - 1))


def bisect(indptr: np.ndarray, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """docs in two halves. indptr, terms: the terms of document i are terms[indptr[i]:indptr[i + 1]]."""
    n = len(docs)
    sizes = indptr[docs + 1] - indptr[docs]
    owner = np.repeat(np.arange(n), sizes)
    edge = terms[np.arange(len(owner)) + np.repeat(indptr[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
    _, edge, df = np.unique(edge, return_inverse=True, return_counts=True)
    telling = (df[edge] > 1) & (df[edge] < n)  # the others cost the same on either side
    owner, edge = owner[telling], edge[telling]
    left = np.arange(n) < (n + 1) // 2
    nl, nr = int(left.sum()), n - int(left.sum())
    # What a term costs in a half that has so many of its documents.
    some = np.arange(n + 2)
    cost_l, cost_r = some * np.log2(nl / (some + 1)), some * np.log2(nr / (some + 1))
    for _ in range(ROUNDS):
        of_left = left[owner]
        dl = np.bincount(edge[of_left], minlength=len(df))
        dr = df - dl
        now = cost_l[dl] + cost_r[dr]
        to_right, to_left = now - cost_l[np.maximum(dl - 1, 0)] - cost_r[dr + 1], now - cost_l[dl + 1] - cost_r[np.maximum(dr - 1, 0)]
        gain = np.bincount(owner, weights=np.where(of_left, to_right[edge], to_left[edge]), minlength=n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swap = int(np.count_nonzero(gain[a[:k]] + gain[b[:k]] > 1e-9))
        if not swap:
            break
        left[a[:swap]], left[b[:swap]] = False, True
    return docs[left], docs[~left]


def ordered(indptr: np.ndarray, terms: np.ndarray, size: int = CLUSTER) -> np.ndarray:
    """All documents in the order of the recursive bisection, down to `size` documents."""
    out, todo = [], [np.arange(len(indptr) - 1)]
    while todo:
        docs = todo.pop()
        if len(docs) <= size:
            out.append(docs)
        else:
            todo += reversed(bisect(indptr, terms, docs))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fitted(sample: list[np.ndarray], levels: int) -> np.ndarray:
    """For each split of the first levels (numbered like a heap, from 1) what a feature gains on the left over the right."""
    weights = np.zeros((1 << levels, FEATURES), np.float32)
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in sample])]).astype(np.int64)
    terms = np.concatenate(sample) if sample else np.zeros(0, np.int64)
    parts = {1: np.arange(len(sample))}
    for node in range(1, 1 << levels):
        docs = parts.pop(node)
        halves = bisect(indptr, terms, docs) if len(docs) > 1 else (docs, docs[:0])
        gap = [np.log2((np.bincount(np.concatenate([sample[i] for i in h]) if len(h) else [], minlength=FEATURES) + 1) / (len(h) + 1)) for h in halves]
        weights[node] = gap[0] - gap[1]
        parts[2 * node], parts[2 * node + 1] = halves
    return weights


def leaf_of(weights: np.ndarray, own: np.ndarray) -> int:
    node = 1
    while node < len(weights):
        node = 2 * node + int(weights[node, own].sum() <= 0)
    return node


def statistics(docs: DataFrame) -> tuple[int, int, list[np.ndarray]]:
    """Documents with terms, all terms, and a sample of documents as features."""
    share = min(1.0, 4 * SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        kept: list[tuple[int, bytes]] = []
        for whole in batches:
            for b in slices(whole, "text"):
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    counts = term_counts(t or "")
                    if counts:
                        n += 1
                        total += counts.total()
                        h = zlib.crc32(f"{i}:{n}".encode())
                        if h < share * 2**32:
                            bits = np.zeros(FEATURES, bool)
                            bits[features(counts)] = True
                            kept.append((h, np.packbits(bits).tobytes()))
        out = [(n, total, None, None), *((0, 0, h, x) for h, x in kept)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["n", "total", "h", "bits"])
        tidy()

    found = written(docs.select("doc_id", "text").mapInArrow(run, "n long, total long, h long, bits binary"), "lexical-sample")
    n, total = found.agg(F.sum("n"), F.sum("total")).first()
    sample = [r.bits for r in found.where("h is not null").orderBy("h", "bits").limit(SAMPLE).select("bits").collect()]
    return n or 0, total or 0, [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in sample]


def forward(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """leaf, doc_id, n, terms (joined by a space) and their counts of every document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if counts := term_counts(t or ""):
                        own = list(counts)
                        rows.append((leaf_of(weights, features(own)), i, counts.total(), b" ".join(own), np.fromiter(counts.values(), "<u4").tobytes()))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["leaf", "doc_id", "n", "terms", "counts"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "leaf int, doc_id long, n long, terms binary, counts binary")


_INDEX = pa.schema([("piece", pa.string()), ("cluster", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("starts", pa.binary()), ("best", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary())])
_INDEX_DDL = "piece string, cluster int, doc_ids array<long>, terms binary, starts binary, best binary, docs binary, impacts binary"


def clusters_of(piece: str, doc_ids: list, lengths: list[int], terms: list[bytes], counts: list[bytes], n_docs: int, n_terms: int) -> pa.Table:
    """The index rows of a piece."""
    names: dict[bytes, int] = defaultdict(itertools.count().__next__)
    own = [np.fromiter(map(names.__getitem__, x.split(b" ")), np.int64) for x in terms]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    flat, tf = np.concatenate(own), np.concatenate([np.frombuffer(x, "<u4") for x in counts]).astype(np.int64)
    del own
    spelt = np.array(list(names), object)
    del names
    m = np.array([100 - 75 + (75 * n * n_docs) // n_terms for n in lengths], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(indptr)))
    shared = np.bincount(flat)[flat] > 1  # the others tell nothing about the order
    order = ordered(np.concatenate([[0], np.cumsum(shared)])[indptr], flat[shared])
    rows = []
    for k, at in enumerate(range(0, len(order), CLUSTER)):
        docs = order[at : at + CLUSTER]
        where = np.concatenate([np.arange(indptr[d], indptr[d + 1]) for d in docs])
        place = np.repeat(np.arange(len(docs)), indptr[docs + 1] - indptr[docs])
        by = np.argsort(flat[where], kind="stable")
        ids, starts = np.unique(flat[where][by], return_index=True)
        impacts = impact[where][by]
        best = np.maximum.reduceat(impacts, starts)
        rows.append((piece, k, [doc_ids[d] for d in docs], b" ".join(spelt[ids]), np.append(starts, len(by)).astype("<u4").tobytes(), best.astype("<i4").tobytes(), place[by].astype("<u2").tobytes(), impacts.astype("<i4").tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX.types, strict=True)], schema=_INDEX)


def index(docs: DataFrame) -> DataFrame:
    """The clustered index of all documents (doc_id, text), a written table with one row a cluster."""
    n, total, sample = statistics(docs)
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, n) / PIECE_DOCS))))
    flat = written(forward(docs, fitted(sample, levels)), "lexical-forward")
    # At most 2^LEVELS rows.
    sizes = flat.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("terms")).alias("bytes")).collect()
    pieces = {r.leaf: max(-(-r.docs // PIECE_DOCS), -(-r.bytes // PIECE_BYTES)) for r in sizes} or {0: 1}
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]), F.col("leaf"))
    piece = F.concat_ws("-", "leaf", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts))

    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_pylist() for c in group.column_names}
        out = clusters_of(cols["piece"][0], cols["doc_id"], cols["n"], cols["terms"], cols["counts"], n, total)
        del cols
        tidy()
        return out

    dealt = flat.select(piece.alias("piece"), "doc_id", "n", "terms", "counts")
    return written(dealt.groupBy("piece").applyInArrow(run, _INDEX_DDL), "lexical-index")


class Cluster:
    """A row of the index as the queries' terms see it: columns of the weight matrix that it holds, and their postings."""

    def __init__(self, row: dict, column: dict[bytes, int]):
        found = [(i, c) for i, t in enumerate(row["terms"].split(b" ")) if (c := column.get(t)) is not None]
        self.at = np.array([i for i, _ in found], np.int64)
        self.columns = np.array([c for _, c in found], np.int64)
        self.starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.row = row

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        return weights[:, self.columns] @ np.frombuffer(self.row["best"], "<i4")[self.at].astype(weights.dtype)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """One row a query, one column a document."""
        docs, impacts = np.frombuffer(self.row["docs"], "<u2"), np.frombuffer(self.row["impacts"], "<i4")
        table = np.zeros((len(self.at), len(self.row["doc_ids"])), weights.dtype)
        for k, i in enumerate(self.at.tolist()):
            part = slice(self.starts[i], self.starts[i + 1])
            table[k, docs[part]] = impacts[part]
        return weights[:, self.columns] @ table


_ROWS = ["piece", "cluster", "doc_ids", "terms", "starts", "best", "docs", "impacts"]


def _frequencies(stored: DataFrame, column: dict[bytes, int]) -> dict[int, int]:
    """Documents of each of the queries' terms, by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(column), np.int64)
        for b in batches:
            for row in b.to_pylist():
                c = Cluster(row, column)
                found[c.columns] += c.starts[c.at + 1] - c.starts[c.at]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["column", "df"])
        tidy()

    rows = stored.select("terms", "starts").mapInArrow(run, "column long, df long").groupBy("column").agg(F.sum("df").alias("df"))
    return {r.column: r.df for r in rows.collect()}


def _first(stored: DataFrame, column: dict[bytes, int], weights: np.ndarray) -> DataFrame:
    """piece, cluster of the best bound of each query in each of FIRST parts of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, str, int]] = {}
        for b in batches:
            for row in b.to_pylist():
                part = zlib.crc32(f"{row['piece']}:{row['cluster']}".encode()) % FIRST
                bounds = Cluster(row, column).bounds(weights)
                for q in np.flatnonzero(bounds).tolist():
                    best[q, part] = max(best.get((q, part), (0, "", 0)), (int(bounds[q]), row["piece"], row["cluster"]))
        cols = list(zip(*((q, part, *x) for (q, part), x in best.items()), strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["q", "part", "bound", "piece", "cluster"])
        tidy()

    each = stored.select("piece", "cluster", "terms", "starts", "best").mapInArrow(run, "q int, part int, bound long, piece string, cluster int")
    return each.groupBy("q", "part").agg(F.max(F.struct("bound", "piece", "cluster")).alias("x")).select("x.piece", "x.cluster").distinct()


def _visited(stored: DataFrame, column: dict[bytes, int], weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """q, doc_id, score of the k best documents of each query in each task, among those that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        floor = np.maximum(least, 1).astype(weights.dtype)
        for b in batches:
            seen = [Cluster(row, column) for row in b.to_pylist()]
            bounds = np.array([c.bounds(weights) for c in seen])
            for i in np.argsort(-bounds.max(axis=1), kind="stable").tolist() if len(seen) else ():
                asked = np.flatnonzero(bounds[i] >= floor)
                if not len(asked):
                    continue
                scores = seen[i].scores(weights[asked])
                ids = seen[i].row["doc_ids"]
                for q, some in zip(asked.tolist(), scores, strict=True):
                    new = [(-int(some[j]), ids[j] is None, ids[j] or 0) for j in np.flatnonzero(some >= floor[q]).tolist()]
                    if new:
                        best[q] = sorted(best.get(q, []) + new)[:k]
                        if len(best[q]) == k:
                            floor[q] = max(floor[q], -best[q][-1][0])
        rows = [(q, None if none else i, -s) for q, found in best.items() for s, none, i in found]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["q", "doc_id", "score"])
        tidy()

    return stored.select(*_ROWS).mapInArrow(run, "q int, doc_id long, score long")


def search(stored: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of an index for each item."""
    spark = stored.sparkSession
    n = stored.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    each = items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    each = written(each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n")), "lexical-items")
    blocks = -(-each.select("item_id").distinct().count() // BLOCK)
    out = each.where("false").select("item_id", F.lit(0).alias("rank"), F.col("n").alias("doc_id"), F.col("n").alias("score"))
    for block in range(blocks if n else 0):
        rows = each.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about BLOCK items
        names = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
        line = {x: i for i, x in enumerate(names)}
        column = {t: i for i, t in enumerate(sorted({r.term.encode() for r in rows}))}
        df = _frequencies(stored, column)
        weight = {c: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for c, x in df.items()}
        weights = np.zeros((len(names), len(column)), np.int64)
        for r in rows:
            c = column[r.term.encode()]
            weights[line[r.item_id], c] = r.n * weight.get(c, 0)
        if weights.sum(axis=1, dtype=np.float64).max(initial=0) * 1_000_000 < 2**53:
            weights = weights.astype(np.float64)  # whole numbers of that size are exact, and products faster
        first = stored.join(F.broadcast(_first(stored, column, weights)), ["piece", "cluster"], "left_semi")  # BLOCK * FIRST rows at most
        found: dict[int, list[int]] = {}
        for r in _visited(first, column, weights, np.zeros(len(names), np.int64), k).groupBy("q").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s")).collect():
            found[r.q] = r.s
        least = np.array([found[q][k - 1] if len(found.get(q, ())) == k else 0 for q in range(len(names))], np.int64)
        hits = _visited(stored, column, weights, least, k)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = hits.withColumn("rank", place).where(F.col("rank") <= k)
        known = spark.createDataFrame([(i, x) for x, i in line.items()], f"q int, item_id {each.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(written(top.join(F.broadcast(known), "q").select("item_id", "rank", "doc_id", "score"), "lexical-hits"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""WITH terms AS (
  SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents) t
), tf AS (
  SELECT row_id, doc_id, term, count(*) AS tf FROM terms GROUP BY row_id, doc_id, term
), len AS (
  SELECT row_id, sum(tf) AS n FROM tf GROUP BY row_id
), corpus AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN corpus GROUP BY term, big_n
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark) t GROUP BY item_id, term
), scored AS (
  SELECT item_id, tf.row_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * CAST(n AS BIGINT) * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (row_id) CROSS JOIN corpus GROUP BY item_id, tf.row_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
