"""Vector search: exact k nearest neighbours of a stated query set, and table maintenance by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small
from .search import top

DIGITS = 10


def squared_distance(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Vectors and queries of one cell of the comparison, at most about so many, and doubles of one tile of distances.
PART, BLOCK, TILE = 1 << 16, 1 << 14, 1 << 22


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).astype(np.float64).reshape(-1, dims) + 0.0


def _nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, doc_id, squared distance of the k nearest of a cell for each query, and of all that rounding may put beside them.

    A matrix product bounds the distances; those that count are summed once more in the order of `squared_distance`. Equal
    vectors are compared once and stand for their k smallest ids: further ones are in no list of k."""
    dims = vectors["_dims"][0].as_py()
    vectors = vectors.take(pc.sort_indices(vectors["doc_id"], null_placement="at_start"))
    v, same = np.unique(_matrix(vectors["vector"], dims), axis=0, return_inverse=True)
    same = same.reshape(-1)
    by = np.argsort(same, kind="stable")
    start = np.searchsorted(same[by], np.arange(len(v) + 1))
    q, lengths = _matrix(queries["q"], dims), (v * v).sum(1)
    step, k_, found = max(1, TILE // len(v)), min(k, len(v)), []
    for at in range(0, len(q), step):
        tile = q[at : at + step]
        own = (tile * tile).sum(1)
        near = lengths[None, :] + own[:, None] - 2 * (tile @ v.T)
        slack = 3e-10 + 16 * (dims + 4) * np.finfo(float).eps * (lengths.max() + own)
        row, col = np.nonzero(near <= (np.partition(near, k_ - 1, axis=1)[:, k_ - 1] + slack)[:, None])
        exact = np.zeros(len(row))
        for i in range(0, len(row), TILE // 16):
            r, c, total = row[i : i + TILE // 16], col[i : i + TILE // 16], 0.0
            for j in range(dims):
                gap = v[c, j] - tile[r, j]
                total = total + gap * gap
            exact[i : i + TILE // 16] = total
        copies = np.minimum(start[col + 1] - start[col], k)
        order = np.lexsort((exact, row))
        row, col, exact, copies = row[order], col[order], exact[order], copies[order]
        # What is farther than the rows that already make k, by more than rounding, is in no list.
        upto = np.cumsum(copies)
        first = np.searchsorted(row, np.arange(len(tile)))
        before = upto - copies - (upto - copies)[first][row]
        reach = np.full(len(tile), -np.inf)
        np.maximum.at(reach, row[before < k], exact[before < k])
        keep = exact <= (reach + slack)[row]
        row, col, exact, copies = row[keep], col[keep], exact[keep], copies[keep]
        each = np.repeat(np.arange(len(row)), copies)
        doc = by[start[col][each] + np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)]
        found.append(pa.table({"query_id": queries["query_id"].take(pa.array(row[each] + at)), "doc_id": vectors["doc_id"].take(pa.array(doc)), "d": exact[each]}))
    return pa.concat_tables(found)


def _known(vector: str) -> F.Column:
    """The length of a vector of numbers; null where it is null, or holds what a matrix product does not bound."""
    return F.when(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= 1e100, F.lit(False))) & (F.size(vector) > 0), F.size(vector))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score = 1 - squared distance, exact. vectors: doc_id, vector; queries: query_id, vector (a stated
    set). Filters on vectors stand before this and reach the scan.

    Every part of the vectors meets every block of the queries in a task of its own, of bounded size, as a matrix product. Pairs
    of vectors that are null, not finite or of other lengths are left to column expressions."""
    v = vectors.select("doc_id", "vector", _known("vector").alias("_dims"))
    q = queries.select("query_id", F.col("vector").alias("q"), _known("vector").alias("_dims"))
    cores, n = v.sparkSession.sparkContext.defaultParallelism, vectors.count()
    parts, blocks = max(-(-n // PART), min(cores, -(-n // 1024)), 1), max(1, -(-queries.count() // BLOCK))
    cell = lambda own, of, many, other, more: own.where("_dims is not null").select("*", F.pmod(F.xxhash64(of), F.lit(many)).cast("int").alias(f"_{of}"), F.explode(F.sequence(F.lit(0), F.lit(more - 1))).alias(f"_{other}")).groupBy("_dims", "_doc_id", "_query_id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return _nearest(left, right, k)
        return pa.table({"query_id": right["query_id"][:0], "doc_id": left["doc_id"][:0], "d": pa.array([], pa.float64())})

    kind = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {v.schema['doc_id'].dataType.simpleString()}, d double"
    near = cell(v, "doc_id", parts, "query_id", blocks).cogroup(cell(q, "query_id", blocks, "doc_id", parts)).applyInArrow(run, kind)
    odd = v.where("_dims is null").drop("_dims").crossJoin(small(q.drop("_dims")))
    odd = odd.unionByName(v.where("_dims is not null").drop("_dims").crossJoin(small(q.where("_dims is null").drop("_dims"))))
    other = v.join(F.broadcast(q.where("_dims is not null").select(F.col("_dims").alias("_other")).distinct()), F.col("_dims") != F.col("_other")).select("doc_id", "vector", "_other")
    odd = odd.unionByName(other.join(q.withColumnRenamed("_dims", "_other"), "_other").select("doc_id", "vector", "query_id", "q"))
    far = odd.select("query_id", "doc_id", squared_distance("vector", "q").alias("d"))
    pairs = near.unionByName(far).select("query_id", "doc_id", F.round(1 - F.col("d"), DIGITS).alias("score"))
    return top(pairs, k).select("query_id", "rank", "doc_id", "score")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows of the same key replaced."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def hashing_embedding(df: DataFrame, text_col: str = "text", dims: int = 384, prefix: str = "search_document: ") -> DataFrame:
    """df with `vector`: words hashed to signed dimensions, L2-normalised. Any model can stand in its place."""
    import re
    import zlib

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dims), np.float32)
            for i, t in enumerate(b.column(text_col).to_pylist()):
                for w in re.findall(r"[a-z0-9]{2,}", re.sub("([a-z])([A-Z])", r"\1 \2", prefix + (t or "")).lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dims] += 1 - 2 * (h >> 31)
            out /= np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dims).cast(pa.list_(pa.float32()))], [*names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, vector array<float>")


#: Dimensions where neither the model nor the caller states any.
DIMENSIONS = 384


@dataclass(frozen=True)
class Model:
    """An embedding: embed(df with a column text, prefix=...) gives df with `vector` of `dims` floats."""

    name: str
    dims: int
    embed: Callable[..., DataFrame]


MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    """Makes a model known by its name; a later one of the name replaces it."""
    MODELS[model.name] = model
    return model


register(Model("hashing", DIMENSIONS, hashing_embedding))


def resolved_dims(requested: float | None, native: float | None) -> int:
    """The smaller of what is asked for and what the model has; a number that is missing or not positive does not count."""
    known = lambda x: x is not None and x == x and 0 < x < float("inf")
    if not known(native):
        return DIMENSIONS
    return int(min(requested, native)) if known(requested) else int(native)


def embedder(name: str = "hashing", dims: int | None = None) -> Callable[..., DataFrame]:
    """The embedding of a registered model, cut to the resolved dimensions; not normalised again."""
    model = MODELS[name]
    size = resolved_dims(dims, model.dims)

    def run(df: DataFrame, **options) -> DataFrame:
        out = model.embed(df, **options)
        return out if size == model.dims else out.withColumn("vector", F.slice("vector", 1, size))

    return run
