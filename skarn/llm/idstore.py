"""Token-id files: zstandard frames of id arrays, one for each document, under one shared trained dictionary.

File format: magic, sha256 of the dictionary, the frames end to end, then the index (ids of documents, frame offsets, token
counts) as little-endian arrays and a fixed tail with the number of documents and where the index starts. A document is
read by its index entry alone. Ids are unsigned 16-bit where the vocabulary allows, else 32-bit.

Documents stand in ascending doc_id order over all files (nulls last; rows of one doc_id by the hash of their text). Each task
writes its range under a name of its own and reports it; only reported files are read, so a repeated or lost task does no harm.

Ids are those of the library as it stands: an added token's string in a text (`<|endoftext|>`) is that token.
Defined cases: a null text has only the end id; repeated rows are stored each; an empty table gives an empty result; too
few samples to train on give a raw-content dictionary; a very long text, also one without white space, is one frame. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import opened, plain_text, scratch, slices, table, tidy, written
from .words import coded_segments, gathered

MAGIC = b"SKID\x01\0\0\0"
_TAIL = struct.Struct("<QQQ8s")  # documents, index start, bytes an id, magic
END_ID = 0
#: Documents sampled (as an expectation) to train the dictionary, and its size.
TRAIN_DOCS, DICT_BYTES = 2000, 64 << 10
LEVEL = 3
#: Segments encoded as one text.
RUN = 200


class Encoder:
    """A tokenizers file, as the library applies it, run on each distinct segment once. Many segments are encoded as one
    text: each of them starts with its only space, so the tokens that start with a space show where the segments begin.

    The segments met so far are an Arrow dictionary, to which a slice's own dictionary is unified; it is forgotten once it
    has more than `memory` entries."""

    def __init__(self, path: str, memory: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.head = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.head[i] = token.startswith("Ġ")
        self.wide = len(self.head) > 1 << 16
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.known, self.starts, self.values = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of segments."""
        texts = new.to_pylist()
        # What starts with its only space and holds more than white space may stand in one text with others of its kind.
        alone = pc.invert(pc.and_(pc.starts_with(new, " "), pc.and_(pc.equal(pc.count_substring(new, " "), 1), pc.invert(pc.utf8_is_space(new))))).to_numpy(zero_copy_only=False)
        for token in self.added:
            alone |= pc.match_substring(new, token).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(alone).tolist()
        runs = [r for r in np.split(np.flatnonzero(~alone), range(RUN, len(new), RUN)) if len(r)]
        lengths, parts = np.zeros(len(new), np.int64), [np.zeros(0, np.uint32)] * len(new)
        order, ids = [], []
        for run, got in zip(runs, self._ids(["".join([texts[i] for i in r]) for r in runs]), strict=True):
            cuts = np.flatnonzero(self.head[got])
            if len(cuts) == len(run) and cuts[0] == 0:
                lengths[run] = np.diff(np.append(cuts, len(got)))
                order.append(run)
                ids.append(got)
            else:
                own += run.tolist()
        for i, got in zip(own, self._ids([texts[i] for i in own]), strict=True):
            lengths[i] = len(got)
            ids.append(got)
        order = np.concatenate([*order, np.array(own, np.int64)]) if order or own else np.zeros(0, np.int64)
        starts, flat = np.concatenate([[0], np.cumsum(lengths[order])]), np.concatenate([np.zeros(0, np.uint32), *ids])
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(order))
        return lengths, gathered(starts, flat, place)[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids) of a large_string array: ids of all texts end to end."""
        if len(self.known) > self.memory:
            self._forget()
        coded, offsets = coded_segments(texts, self.added)
        empty = pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), self.known)
        both = pa.chunked_array([empty, coded]).unify_dictionaries()
        coded = both.chunk(both.num_chunks - 1)
        new = coded.dictionary.slice(len(self.known)) if len(coded) else self.known.slice(0, 0)
        if len(new):
            lengths, ids = self._many(new)
            self.known = coded.dictionary
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.values = np.concatenate([self.values, ids])
        ids, lengths = gathered(self.starts, self.values, coded.indices.to_numpy(zero_copy_only=False))
        return np.concatenate([[0], np.cumsum(lengths)])[offsets], ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def fit_dictionary(df: DataFrame, tokenizer: str, id_col: str, text_col: str, docs: int = TRAIN_DOCS) -> bytes:
    """Trained in one executor task on about `docs` documents, drawn by row, so that a repeated id or text draws no more."""
    n = max(1, df.count())
    chosen = df.where((F.rand(11) < docs / n) & F.col(text_col).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, samples = encoder(tokenizer), []
        for b in batches:
            for part in slices(b, "text"):
                starts, ids = e.encode(plain_text(part.column("text")))
                ids = ids.astype("<u4" if e.wide else "<u2")
                samples += [ids[starts[i] : starts[i + 1]].tobytes() for i in range(part.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([train(sorted(samples))], pa.binary())], ["dictionary"])

    got = chosen.select(F.col(text_col).alias("text")).repartition(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(got[0][0]) if got else b""


class Writer:
    """Writes one file; `close` gives its path, documents and tokens."""

    def __init__(self, folder: str, dictionary: bytes, wide: bool):
        self.path = f"{folder}/{uuid.uuid4().hex}.skid"
        self.fs, self.at = opened(self.path)
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.at + ".part")
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        self.kind = "<u4" if wide else "<u2"
        self.place, self.ids, self.offsets, self.counts = len(MAGIC) + 32, [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.codec.compress(ids.astype(self.kind).tobytes())
        self.out.write(frame)
        self.ids.append(doc_id)
        self.offsets.append(self.place)
        self.counts.append(len(ids))
        self.place += len(frame)

    def close(self) -> tuple[str, int, int]:
        null = np.array([i is None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes() + np.array([*self.offsets, self.place], "<u8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(index + _TAIL.pack(len(self.ids), self.place, int(self.kind[-1]), MAGIC))
        self.out.close()
        self.fs.move(self.at + ".part", self.at)
        return self.path, len(self.ids), int(sum(self.counts))


class Reader:
    """Random access to one file."""

    def __init__(self, path: str, dictionary: bytes):
        files, at = opened(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        n, start, width, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        if self._read(len(MAGIC), 32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        index = self._read(start, size - _TAIL.size - start)
        ids, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.offsets = np.frombuffer(index[9 * n : 17 * n + 8], "<u8")
        self.counts = np.frombuffer(index[17 * n + 8 :], "<u4")
        self.codec = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        self.kind = f"<u{width}"

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, read by its index entry alone."""
        frame = self._read(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))
        return np.frombuffer(self.codec.decompress(frame), self.kind)


def write_ids(df: DataFrame, tokenizer: str, folder: str, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and stores all texts in ascending id order; the written table of files: part (their order), path, docs, tokens.

    Ranges are cut by id, then text, then row, so rows of one id (or of none) are many ranges where they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, end = encoder(tokenizer), None, np.full(1, END_ID, np.uint32)
        for whole in batches:
            for b in slices(whole, "text"):
                starts, ids = e.encode(plain_text(b.column("text")))
                for i, doc_id in enumerate(b.column("id").to_pylist()):
                    if out is None:
                        out = Writer(folder, dictionary, e.wide)
                    out.add(doc_id, np.concatenate([ids[starts[i] : starts[i + 1]], end]))
        if out is not None:
            path, docs, tokens = out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "docs", "tokens"])
        tidy()

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    ranged = src.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    return written(ranged.mapInArrow(run, "part long, path string, docs long, tokens long"), "id-files")


def read_ids(files: DataFrame, dictionary: bytes) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    # One row a file: what stands before each is a running sum over this small table.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                r = Reader(path, dictionary)
                starts = start + np.cumsum(r.counts, dtype=np.int64) - r.counts
                crc = [zlib.crc32(r.document(i).astype("<u4").tobytes()) for i in range(len(r.ids))]
                yield pa.RecordBatch.from_arrays([pa.array(r.ids, pa.int64()), pa.array(starts), pa.array(r.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("path", before.cast("long").alias("start")).repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, tokenizer = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    dictionary = fit_dictionary(docs, tokenizer, "doc_id", "text")
    files = write_ids(docs, tokenizer, scratch(spark, "ids"), dictionary)
    return read_ids(files, dictionary).withColumnRenamed("id", "doc_id")
