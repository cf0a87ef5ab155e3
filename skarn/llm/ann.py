"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, projected on their principal axes and turned by a learned rotation (alternating sign codes and
orthogonal Procrustes), one bit for the sign of each coordinate. The model is fitted on about SAMPLE vectors, chosen by the
hash of their id; every vector is indexed.

Index: each task codes the vectors of its partition and keeps a bucket index for each 8-bit substring. A query probes, for
radius r over m substrings, all buckets within r // m bits (r // m - 1 beyond the first r % m + 1 substrings): by the
pigeonhole principle every code within r bits is met. Codes within r are reranked by exact distance. The radius grows until
it reaches the calibrated RECALL quantile of Hamming distances at the distance of the k-th best so far.

Queries are a written table that index tasks read in blocks, so no side is broadcast or crossed as a whole; each task keeps
its k best for each query, and a window with a group limit merges them.

Defined cases: vectors that are null, zero or hold null or non-finite numbers take no part, as queries or candidates; vectors
of different lengths have no distance, so each length is a search of its own, with its own model; ties go to the smaller id; equal vectors are all candidates; fewer candidates than k are all
returned; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import opened, scratch, table
from .words import gathered

SAMPLE, MOST_BITS, ROUNDS = 10_000, 256, 30
#: Quantile of the Hamming distances of neighbours at a distance that the radius covers.
RECALL = 0.97
QUERY_BLOCK = 1024
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: All masks of 8 bits, those with fewer bits first; and how many have at most 0, 1, ... 8 bits.
_MASKS = np.argsort(_POP, kind="stable").astype(np.uint8)
_WITHIN = np.cumsum(np.bincount(_POP))


class Coder:
    """Centre, learned rotation, and the radius that covers neighbours at a given distance."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
        z = x - self.centre
        bits = min(x.shape[1], MOST_BITS)
        bits += -bits % 8
        _, _, axes = np.linalg.svd(z.T @ z)
        axes = np.vstack([axes, rng.normal(size=(max(0, bits - len(axes)), x.shape[1]))])[:bits]
        v = z @ axes.T
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            a, _, b = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (a @ b).T
        self.project = axes.T @ turn
        self.bits = bits
        self._calibrate(x, rng)

    def _calibrate(self, x: np.ndarray, rng: np.random.Generator) -> None:
        """Steps of distance, and the RECALL quantile of Hamming distances of pairs up to each."""
        pick = rng.choice(len(x), min(len(x), 200), replace=False) if len(x) else np.zeros(0, int)
        codes, far, bits = self.encode(x), [], []
        for i in pick:
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            near = np.argsort(d, kind="stable")[1 : 1 + max(20, len(x) // 50)]
            far.append(d[near])
            bits.append(_POP[codes[near] ^ codes[i]].sum(1, dtype=np.int64))
        d, h = np.concatenate(far or [np.zeros(0)]), np.concatenate(bits or [np.zeros(0, np.int64)])
        order = np.argsort(d, kind="stable")
        parts = [p for p in np.array_split(order, 64) if len(p)]
        self.steps = np.array([d[p[-1]] for p in parts])
        self.radii = np.maximum.accumulate(np.array([np.ceil(np.quantile(h[p], RECALL)) for p in parts] or [0.0]))[: len(parts)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, bits / 8) bytes."""
        return np.packbits((x - self.centre) @ self.project >= 0, axis=1)

    def radius(self, distance: float) -> int:
        at = np.searchsorted(self.steps, distance)
        return int(self.radii[at]) if at < len(self.steps) else self.bits


class MultiIndex:
    """Vectors, their codes, and for each byte of the codes the positions by its value."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray):
        self.coder, self.ids, self.vectors = coder, ids, vectors
        self.codes = coder.encode(vectors.astype(np.float64)) if len(ids) else np.zeros((0, coder.bits // 8), np.uint8)
        self.order = [np.argsort(c, kind="stable") for c in self.codes.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in self.codes.T]

    def within(self, code: np.ndarray, radius: int, met: np.ndarray) -> np.ndarray:
        """Positions of all codes within the radius; `met` marks the positions of probed buckets."""
        m = len(code)
        a, rest = divmod(radius, m)
        for j in range(m):
            reach = min(8, a if j <= rest else a - 1)
            if reach >= 0:
                values = _MASKS[: _WITHIN[reach]] ^ code[j]
                met[gathered(self.starts[j], self.order[j], values)[0]] = True
        at = np.flatnonzero(met)
        return at[_POP[self.codes[at] ^ code].sum(1, dtype=np.int64) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, by distance, then id."""
        q = query.astype(np.float64)
        code = self.coder.encode(q[None])[0]
        met = np.zeros(len(self.ids), bool)
        radius = min(self.coder.bits, len(code) - 1)
        while True:
            at = self.within(code, radius, met)
            at = at[self.ids[at] != query_id]
            d = np.sqrt(((self.vectors[at].astype(np.float64) - q) ** 2).sum(1))
            if radius >= self.coder.bits:
                break
            want = self.coder.radius(np.partition(d, k - 1)[k - 1]) if len(d) >= k else radius + len(code)
            if radius >= want:
                break
            radius = min(self.coder.bits, max(radius + 1, min(want, radius + len(code))))
        if len(d) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[near], d[near]
        best = np.lexsort((self.ids[at], d))[:k]
        return self.ids[at][best], d[best]


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the vectors that take part."""
    v = F.col("vector")
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """A pickled Coder, fitted in one executor task on the bounded sample; None without vectors."""
    share = min(1.0, sample / max(1, vectors.count()))
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(31)), 11) / F.lit(float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [_matrix(b.column("vector")) for b in batches if b.num_rows]
        if some:
            x = np.concatenate(some).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Coder(x[np.lexsort(x.T)]))], pa.binary())], ["model"])

    # At least some vectors of a tiny table: the sample is what is below the share, or everything.
    got = vectors.where(chance < F.lit(share)).select("vector").repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(got[0][0]) if got else None


def _blocks(folder: str) -> Iterator[pa.RecordBatch]:
    files, at = opened(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among the vectors of other ids."""
    size = F.size("vector")
    lengths = sorted(r.n for r in queries.select(size.alias("n")).distinct().collect())  # most often one
    found = [_search(vectors.where(size == n), queries.where(size == n), k) for n in lengths]
    return functools.reduce(DataFrame.unionByName, found or [_search(vectors.limit(0), queries, k)])


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folder = scratch(spark, "queries")
    queries.write.parquet(folder)
    sent = spark.sparkContext.broadcast(model)  # of bounded size: bits x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        index = MultiIndex(pickle.loads(sent.value), ids, np.concatenate([_matrix(b.column("vector")) for b in held]))
        for block in _blocks(folder):
            out = [(i, *index.nearest(i, v, k)) for i, v in zip(block.column("id").to_pylist(), _matrix(block.column("vector")), strict=True)]
            found = np.concatenate([x[1] for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]), pa.int64()), pa.array(found, pa.int64()), pa.array(np.concatenate([x[2] for x in out]))], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return vectors.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % 100 == 0))
