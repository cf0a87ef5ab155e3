"""N-gram Jaccard join: exact components of documents whose sets of 5-word shingles overlap by 0.75 or more.

Order. Shingles are 64-bit hashes. A sketch of 2**20 to 2**24 counters over all documents (by their number) gives a
common order, rare first; any order gives exact results, a rare-first one few candidates. Similar sets share SHARED of their first
|x| - ceil(0.75 |x|) + SHARED shingles.

Index. Each task packs the postings (shingle, document, size, position) of its documents by bucket of the shingle; a bucket's
lists are sorted by position, so the front of a list holds the sets with the fewest rarer shingles. List level: for a probe,
entries are taken in blocks by position, and blocks whose position bound cannot reach the threshold are skipped.

Two rounds. First every long list links its front entry to the others, and short lists give all their pairs, of which those that
share enough in all short lists stay; a pair that also meets in a long list is left to the second round. Pairs are verified by
exact intersection and connected. Then pairs of long lists that lie in different components are looked at: each entry carries
a parity bitmap of its set, and the bits in which two bitmaps differ are no more than the sets' difference, so most pairs that
are no links end there, inside the task, and make no row. First each part of a list gives a forest of its closest pairs, at most
one row an entry, however many of a group are alike; these are verified and connected. What still lies in different components
and passes the bitmaps, all of it near the threshold, is verified then.
Answer level: those of one component are highly similar, so |x & y| is derived from the answer of the component's pivot p:
|p & y| - |(p - x) & y| + |(x - p) & y|, where only the differences are looked up, and skipped where the bound |p & y| +
|x - p| is too small.

Equal sets are one node. What is verified together is one anchor and at most MEMBERS of its partners (or ANCHORS anchors of
one component), streamed, so no group of copies is held in one task's memory. A list of more than SPLIT entries is dealt over
buckets by document, and in the second round every list over parts of HELD entries.

Defined cases: a null text, or one without words, has size 0 and is a component of its own; fewer than five words are one
shingle, linked only with the same sequence; rows of one doc_id are one node; rows with a null doc_id get a null component
and link nothing; a very long text is one set of as many shingles, read whole in slices; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text, slices, table, tidy, written
from .components import components, merged
from .words import spaced

GRAM = 5
#: The threshold as a fraction.
NUM, DEN = 3, 4
#: Counters of the sketch, as powers of two: four for each document within these bounds. They are sent in CHUNKS parts.
SKETCH_BITS, CHUNKS = (20, 24), 64
#: Similar sets share so many (or all that the threshold asks of them, if fewer) of their first |x| - ceil(0.75 |x|) + SHARED
#: shingles. One alone is common by chance, and such pairs grow with the square of the corpus.
SHARED = 3
#: Lists up to this length give all their pairs at once.
SHORT = 16
#: Partners of an anchor, and anchors of a component, that are verified together.
MEMBERS, ANCHORS = 512, 32
#: Postings that a task packs at once.
FLUSH = 750_000
#: Bytes of text shingled at once; its words and shingles take some 20 times as much.
SLICE = 4 << 20
BLOCK = 256
#: Bits of the filter of document ids, sixteen for each within these bounds.
BLOOM_BITS = (1 << 20, 1 << 28)
#: Bits of a set's bitmap, four for each shingle within these bounds. Wider ones let fewer pairs through to verification.
PARITY_BITS = (64, 1 << 15)
#: Bits of a shingle's hash that a posting keeps besides its bucket. Fewer would only add pairs that verification rejects.
KEPT_BITS = 40
_KEPT = np.uint64((1 << KEPT_BITS) - 1)
#: The highest bit kept tells a shingle whose counter exceeds twice the mean counter by SPLIT. Its postings are dealt over buckets by document.
_HOT = np.uint64(1 << (KEPT_BITS - 1))
SPLIT = 100_000
#: Entries of a list that probes meet in one task.
HELD = 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): each text's distinct shingles, ascending, end to end."""
    words = spaced(pc.ascii_lower(texts))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), np.uint64, len(words.distinct))
    w = own[words.index] if len(words.index) else np.zeros(0, np.uint64)
    n = np.diff(words.offsets)
    total = len(w)
    h = np.zeros(total, np.uint64)
    for k in range(gram):
        h[: max(0, total - k)] = h[: max(0, total - k)] * _MULT + w[k:]
        if k == gram - 1 and total:
            h[max(0, total - k) :] = 0
    h = _mixed(h)
    counts = np.maximum(n - gram + 1, (n > 0).astype(n.dtype))
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.offsets[:-1], counts)
    out = h[place] if total else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    for i in np.flatnonzero((n > 0) & (n < gram)):
        whole = xxhash.xxh3_64_intdigest(w[words.offsets[i] : words.offsets[i + 1]].tobytes(), seed=int(n[i]))
        out[starts[i]] = whole
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s > 1:
            out[s:e].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[starts[:-1][counts > 0]] = True
    return np.concatenate([[0], np.cumsum(keep)])[starts], out[keep]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(na: int, nb: int, both: int) -> bool:
    return DEN * both >= NUM * (na + nb - both)


def _power(n: int, bounds: tuple[int, int]) -> int:
    """The power of two from n on, within bounds."""
    return min(bounds[1], max(bounds[0], 1 << max(0, n - 1).bit_length()))


def parity(own: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each shingle flips the bit of its hash."""
    width = _power(4 * len(own), PARITY_BITS)
    bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (bytes, along the last axis) brought to `width` bytes: those that the shorter hash would have given."""
    while bitmaps.shape[-1] > width:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] ^ bitmaps[..., half:]
    return bitmaps


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many bits differ: never more than the size of the sets' symmetric difference."""
    width = min(one.shape[-1], many.shape[-1])
    return np.bitwise_count(_folded(many, width) ^ _folded(one, width)).sum(-1, dtype=np.int64)


# ---- passes over the texts


def _profiles(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, n, print (of the set); and for each task CHUNKS parts of its 2**bits counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "print", "chunk", "counts"]
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                starts, sets = shingle_sets(plain_text(b.column("text")))
                counters += np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                prints = [xxhash.xxh3_128_digest(sets[s:e].tobytes()) if e > s else None for s, e in zip(starts[:-1], starts[1:], strict=True)]
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(starts)), pa.array(prints, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(x.tobytes()) for x in np.split(counters, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)
        tidy()

    return written(docs.mapInArrow(run, "doc_id long, n long, print binary, chunk int, counts binary"), "join-profiles")


def _order(profiles: DataFrame, bits: int) -> np.ndarray:
    """The summed counters: 2**bits numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for k, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(z.decompress(x), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = profiles.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(run, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.uint64)
    for k, x in parts:
        out[k] += np.frombuffer(x, np.uint64)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


def _pack(token: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray) -> bytes:
    token = token & _KEPT
    ids, at = np.unique(doc, return_inverse=True)
    sizes = np.zeros(len(ids), np.uint32)
    sizes[at] = size
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()  # noqa: E731  alike bytes together
    order = np.argsort(token)
    short = token[order].view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8]
    body = b"".join([np.ascontiguousarray(short.T).tobytes(), planes(at[order].astype(np.uint32)), planes(pos[order].astype(np.uint32)), planes(ids), planes(sizes)])
    return np.array([len(token), len(ids)], np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.uint32, 2).tolist()
    body = zstandard.ZstdDecompressor().decompress(blob[8:])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : KEPT_BITS // 8] = np.frombuffer(body, np.uint8, n * (KEPT_BITS // 8)).reshape(KEPT_BITS // 8, n).T
    out, at = [wide.view(np.uint64).reshape(-1)], n * (KEPT_BITS // 8)
    for count, kind in ((n, np.uint32), (n, np.uint32), (m, np.int64), (m, np.uint32)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, count * width, at).reshape(width, count).T).view(kind).reshape(-1))
        at += count * width
    token, place, pos, ids, sizes = out
    return token, ids[place], sizes[place].astype(np.int64), pos.astype(np.int64)


def _postings(docs: DataFrame, order: np.ndarray, buckets: int, split: int = SPLIT) -> DataFrame:
    """bucket, blob: the prefix postings of all documents; equal sets of a task once. A list of more than `split` entries
    is dealt over several buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        shift, noise = np.uint64(64 - (len(counts).bit_length() - 1)), 2 * int(counts.mean())
        held: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for t, *_ in held])
            token = np.concatenate([t for t, *_ in held])
            doc = np.repeat(np.array([d for _, d, *_ in held], np.int64), lengths)
            size = np.repeat(np.array([n for _, _, n, _ in held], np.uint32), lengths)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            salts = np.concatenate([x for *_, x in held]).astype(np.uint64)
            salt = _mixed(doc.view(np.uint64) * _MULT) % (salts + np.uint64(1))
            bucket = (_mixed(token * _MULT + salt) % np.uint64(buckets)).astype(np.int64)
            token = np.where(salts > 0, token | _HOT, token & ~_HOT)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            parts = [p for p in np.split(by, cuts) if len(p)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([_pack(token[p], doc[p], size[p], pos[p]) for p in parts], pa.binary())], ["bucket", "blob"])

        for whole in batches:
            for b in slices(whole, "text", SLICE):
                starts, sets = shingle_sets(plain_text(b.column("text")))
                for doc_id, s, e in zip(b.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    n = e - s
                    own = sets[s:e]
                    mark = xxhash.xxh3_128_digest(own.tobytes()) if n else None
                    if not n or doc_id is None or mark in seen:
                        continue
                    seen.add(mark)
                    # Ascending hashes, so a stable sort by count orders by (count, hash).
                    often = counts[(own >> shift).astype(np.int64)]
                    first = np.argsort(often, kind="stable")[: n - -(-NUM * n // DEN) + SHARED]
                    held.append((own[first], doc_id, n, np.maximum(often[first].astype(np.int64) - noise, 0) // split))
                    waiting += len(first)
                    if waiting >= FLUSH:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()
        tidy()

    return docs.mapInArrow(run, "bucket int, blob binary")


def _may(sa: np.ndarray, pa_: np.ndarray, sb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold if at most SHARED - 1 shingles are shared before these positions."""
    return (DEN * np.minimum(sa, sb) >= NUM * np.maximum(sa, sb)) & (np.minimum(sa - pa_, sb - pb) + SHARED - 1 >= _need(sa, sb))


def _need(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """The least intersection of similar sets of these sizes."""
    return -(-NUM * (sa + sb) // (NUM + DEN))


def _distinct_pairs(a: np.ndarray, b: np.ndarray, hits: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs with the sum of their hits."""
    order = np.lexsort((b, a))
    a, b, hits, need = a[order], b[order], hits[order], need[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(hits, at) if len(at) else hits
    real = a[at] != b[at]
    return a[at][real], b[at][real], total[real], need[at][real]


def candidates_of(token: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[tuple[np.ndarray, ...], list]:
    """Of one bucket: the pairs of the first round with the shingles they share and those they must, and the long lists as (shingle of a dealt list, documents, sizes, positions)."""
    order = np.lexsort((doc, pos, token))
    token, doc, size, pos = token[order], doc[order], size[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(token)))
    hot = (token[first] & _HOT) > 0
    some = np.repeat((length > 1) | hot, length)
    token, doc, size, pos = token[some], doc[some], size[some], pos[some]
    length, hot = length[(length > 1) | hot], hot[(length > 1) | hot]
    first = np.cumsum(length) - length
    kept = (length > SHORT) | hot
    long = np.repeat(kept, length)
    lefts, rights, hits, needs = ([np.zeros(0, np.int64)] for _ in range(4))
    for d in range(1, SHORT):
        at = np.flatnonzero((token[:-d] == token[d:]) & ~long[:-d]) if len(token) > d else []
        if not len(at):
            break
        at = at[_may(size[at], pos[at], size[at + d], pos[at + d])]
        lefts.append(np.minimum(doc[at], doc[at + d]))
        rights.append(np.maximum(doc[at], doc[at + d]))
        hits.append(np.ones(len(at), np.int64))
        needs.append(np.minimum(SHARED, _need(size[at], size[at + d])))
    head = np.repeat(first, length)
    at = np.flatnonzero(long & (np.arange(len(token)) > head))
    at = at[_may(size[head[at]], pos[head[at]], size[at], pos[at])]
    lefts.append(doc[head[at]])
    rights.append(doc[at])
    hits.append(np.full(len(at), SHARED))  # the front of a long list is verified in any case
    needs.append(np.zeros(len(at), np.int64))
    pairs = _distinct_pairs(*(np.concatenate(x) for x in (lefts, rights, hits, needs)))
    lists = []
    for f, n, h in zip(first[kept].tolist(), length[kept].tolist(), hot[kept].tolist(), strict=True):
        lists.append((int(token[f]) if h else None, doc[f : f + n], size[f : f + n], pos[f : f + n]))
    return pairs, lists


def _candidates(postings: DataFrame) -> DataFrame:
    """a, b: pairs of the first round; list, doc, size, pos: entries of long lists, and whether an entry leads its part of a
    dealt list. One bucket is held at a time."""
    names = ["a", "b", "hits", "need", "list", "doc", "size", "pos", "lead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            pairs, lists = candidates_of(*(np.concatenate(x) for x in zip(*map(_unpack, held), strict=True)))
            held.clear()
            n = len(pairs[0])
            if n:
                yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.bool_())], names)
            merged: dict[int, tuple] = {}
            rows = []
            for token, doc, size, pos in lists:
                if token is not None:
                    rows.append((token, doc, size, pos, np.arange(len(doc)) == 0))
                    continue
                by = np.argsort(doc, kind="stable")  # lists of the same documents are one, at the least positions
                key = xxhash.xxh3_64_intdigest(doc[by].tobytes()) >> 1
                merged[key] = (doc[by], size[by], np.minimum(pos[by], merged[key][2]) if key in merged else pos[by])
            rows += [(key, *x, np.zeros(len(x[0]), bool)) for key, x in merged.items()]
            for key, doc, size, pos, lead in rows:
                n = len(doc)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(np.full(n, key, np.int64)), pa.array(doc), pa.array(size), pa.array(pos), pa.array(lead)], names)

        held, now = [], None
        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k != now and held:
                    yield from close()
                now = k
                held.append(blob)
        if held:
            yield from close()

    return written(postings.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, hits long, need long, list long, doc long, size long, pos long, lead boolean"), "join-candidates")


# ---- verification


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64) * _MULT) % np.uint64(size)).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes, eight to a byte. Beyond the upper bound of BLOOM_BITS they filter less; results stay."""
    ids = written(ids.distinct(), "join-ids")
    size = _power(16 * ids.count(), BLOOM_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_places(b.column("doc").to_numpy(), size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())], pa.binary())], ["bits"])

    out = np.zeros(size // 8, np.uint8)
    for (x,) in ids.repartition(4).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x)), np.uint8)
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, text of the documents that may be among the ids: the filter runs before any text is shuffled. Its bits are a
    broadcast, not a literal, as a literal would stand in every printed plan."""
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column("doc").to_numpy(), 8 * len(sent.value))
            yield b.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))

    return docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text").mapInArrow(run, "doc long, text string")


def _bitmaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, bits (its bitmap) of the documents among the ids, or more. Made again where a doc_id has several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                starts, sets = shingle_sets(plain_text(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([parity(sets[s:e]).tobytes() for s, e in itertools.pairwise(starts.tolist())], pa.binary())], ["doc", "bits"])
        tidy()

    return _texts(docs, ids).mapInArrow(run, "doc long, bits binary")


class _Group:
    """Anchors of one group, held; partners are streamed past them."""

    def __init__(self) -> None:
        self.pivot: np.ndarray | None = None
        self.anchors: dict[int, list[np.ndarray]] = {}
        self.answers: dict[tuple[int, int], int] = {}

    def links(self, x: np.ndarray, against: list[int] | None) -> list[int]:
        """Anchors that x is linked with. With a pivot, answers are derived from the pivot's where x differs little from it."""
        out = []
        gone = came = None
        if self.pivot is not None:
            shared = np.isin(x, self.pivot, assume_unique=True)
            came = x[~shared]
            if len(came) * 2 < len(x):
                gone = self.pivot[np.isin(self.pivot, x, assume_unique=True, invert=True)]
        for y in against if against is not None else self.anchors:
            for k, s in enumerate(self.anchors.get(y, ())):
                if DEN * min(len(x), len(s)) < NUM * max(len(x), len(s)):
                    continue
                if gone is not None:
                    if (y, k) not in self.answers:
                        self.answers[y, k] = overlap(self.pivot, s)
                    base = self.answers[y, k]
                    if not similar(len(x), len(s), min(len(x), base + len(came))):
                        continue
                    both = base - overlap(gone, s) + overlap(came, s)
                else:
                    both = overlap(x, s)
                if similar(len(x), len(s), both):
                    out.append(y)
                    break
        return out


def _verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b of the true links. members: g, salt (the group), role (0 pivot, 1 anchor, 2 partner), doc, against."""
    joined = members.join(_texts(docs, members.select("doc")), "doc")
    rows = joined.repartition(F.col("g"), F.col("salt")).sortWithinPartitions("g", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, _Group()
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                starts, sets = shingle_sets(plain_text(b.column("text")))
                a, c = [], []
                keys = zip(b.column("g").to_pylist(), b.column("salt").to_pylist(), strict=True)
                for i, (key, role, doc, against) in enumerate(zip(keys, b.column("role").to_pylist(), b.column("doc").to_pylist(), b.column("against").to_pylist(), strict=True)):
                    own = sets[starts[i] : starts[i + 1]].copy() if role < 2 else sets[starts[i] : starts[i + 1]]
                    if key != now:
                        now, group = key, _Group()
                    if role == 0:
                        group.pivot = own
                    elif role == 1:
                        group.anchors.setdefault(doc, []).append(own)
                    else:
                        for y in group.links(own, against):
                            a.append(y)
                            c.append(doc)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])
        tidy()

    return written(rows.select("g", "salt", "role", "doc", "against", "text").mapInArrow(run, "a long, b long"), "join-links")


def _first_members(pairs: DataFrame) -> DataFrame:
    """Groups of an anchor a and up to about MEMBERS of its partners b."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
    salted = written(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "join-pairs")
    none = F.lit(None).cast("array<bigint>")
    anchors = salted.select(F.col("a").alias("g"), "salt", F.lit(1).alias("role"), F.col("a").alias("doc"), none.alias("against")).distinct()
    return anchors.unionByName(salted.select(F.col("a").alias("g"), "salt", F.lit(2).alias("role"), F.col("b").alias("doc"), none.alias("against")))


class ListPart:
    """Entries of one list that probes meet, in blocks by position; a block is skipped where no position or size in it can do.
    With `forest`, components that a pair was given for count as one from then on."""

    def __init__(self, doc: list[int], size: list[int], pos: list[int], label: list[int], bits: list[bytes | None], main: int, forest: bool):
        order = np.lexsort((doc, pos))
        self.doc, self.size, self.pos, self.label = (np.array(x, np.int64)[order] for x in (doc, size, pos, label))
        self.main, self.forest = main, forest
        self.now, self.joined = self.label.copy(), {}
        self.cuts = np.arange(0, len(doc), BLOCK)
        self.room = np.maximum.reduceat(self.size - self.pos, self.cuts)
        self.least, self.most = np.minimum.reduceat(self.size, self.cuts), np.maximum.reduceat(self.size, self.cuts)
        # Bitmaps by width; 0 where there is none.
        bits = [bits[i] or b"" for i in order.tolist()]
        self.width = np.array([len(x) for x in bits])
        self.row, self.maps = np.zeros(len(bits), np.int64), {}
        for w in set(self.width.tolist()) - {0}:
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.maps[w] = np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint8).reshape(len(at), w)

    def partners(self, doc: int, size: int, pos: int, label: int, bits: bytes | None = None) -> np.ndarray:
        """Places of the entries of other components that may reach the threshold with the probe. Of two entries outside the
        largest component, the one with the larger id probes."""
        label = self._find(label)
        low, high = -(-NUM * size // DEN), DEN * size // NUM
        need = -(-NUM * (size + np.maximum(self.least, low)) // (NUM + DEN))
        out = [np.zeros(0, np.int64)]
        for k in np.flatnonzero((self.most >= low) & (self.least <= high) & (np.minimum(self.room, size - pos) + SHARED - 1 >= need)).tolist():
            s = slice(self.cuts[k], self.cuts[k] + BLOCK)
            good = _may(size, pos, self.size[s], self.pos[s]) & (self.now[s] != label) & ((self.label[s] == self.main) | (self.doc[s] < doc))
            out.append(np.flatnonzero(good) + self.cuts[k])
        at = np.concatenate(out)
        far = self._differing(at, bits)
        # Similar sets differ in at most |x| + |y| - 2 need shingles.
        good = far <= size + self.size[at] - 2 * _need(size, self.size[at])
        return self._closest(at[good], far[good], label) if self.forest else at[good]

    def _differing(self, at: np.ndarray, bits: bytes | None) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        if bits:
            one, widths = np.frombuffer(bits, np.uint8), self.width[at]
            for w in set(widths.tolist()) - {0}:
                some = widths == w
                out[some] = differing(one, self.maps[w][self.row[at[some]]])
        return out

    def _find(self, label: int) -> int:
        while label in self.joined:
            label = self.joined[label]
        return label

    def _closest(self, at: np.ndarray, far: np.ndarray, label: int) -> np.ndarray:
        """The closest entry of each component, which becomes one with the probe's."""
        out = []
        while len(at):
            k = at[np.argmin(far)]
            out.append(k)
            other = self.now[k]
            self.joined[int(other)] = label
            self.now[self.now == other] = label
            left = self.now[at] != label
            at, far = at[left], far[left]
        return np.array(out, np.int64)


def _mixed_lists(entries: DataFrame, held: int) -> DataFrame:
    """The entries of lists of more than one component, with the list's largest component and number of parts."""
    counts = entries.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("list").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    return entries.join(mixed.select("list", "main", F.ceil(F.col("n") / held).alias("parts")), "list")


def _cross(e: DataFrame, forest: bool) -> DataFrame:
    """Distinct (probe y, partner x, component g of x) over all long lists. e: list, doc (a node), size, pos, label, bits, main, parts.

    A list is dealt over its parts; entries outside its largest component probe every part."""
    own = e.select("list", F.pmod(F.xxhash64("doc"), "parts").alias("part"), F.lit(0).alias("role"), "doc", "size", "pos", "label", "bits", "main")
    probes = e.where("label <> main").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "doc", "size", "pos", "label", "bits", "main")
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, part = None, [], None
        for b in batches:
            y, x, g = [], [], []
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[:2] != now:
                    now, waiting, part = row[:2], [], None
                if row[2] == 0:
                    waiting.append(row[3:8])
                    continue
                if part is None:
                    part = ListPart(*zip(*waiting, strict=True), row[8], forest) if waiting else False
                if part:
                    at = part.partners(*row[3:8])
                    y.append(np.full(len(at), row[3], np.int64))
                    x.append(part.doc[at])
                    g.append(part.label[at])
            if y:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (y, x, g)], ["y", "x", "g"])
        tidy()

    # Within a part by role, so that the entries stand before the probes.
    both = own.unionByName(probes).repartition("list", "part").sortWithinPartitions("list", "part", "role", "doc")
    return both.mapInArrow(run, "y long, x long, g long").distinct()


def _second_members(cross: DataFrame) -> DataFrame:
    """Groups of a component g with its pivot, up to about ANCHORS probes, and the partners in the component."""
    salts = cross.select("g", "y").distinct().groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("salts"))
    salted = written(cross.join(salts, "g").select("g", "x", "y", F.pmod(F.xxhash64("y"), F.col("salts")).alias("salt")), "join-cross")
    none = F.lit(None).cast("array<bigint>")
    pivots = salted.select("g", "salt", F.lit(0).alias("role"), F.col("g").alias("doc"), none.alias("against")).distinct()
    anchors = salted.select("g", "salt", F.lit(1).alias("role"), F.col("y").alias("doc"), none.alias("against")).distinct()
    # At most ANCHORS or so of a partner's probes are in a group.
    partners = salted.groupBy("g", "salt", "x").agg(F.collect_list("y").alias("against")).select("g", "salt", F.lit(2).alias("role"), F.col("x").alias("doc"), "against")
    return pivots.unionByName(anchors).unionByName(partners)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, held: int = HELD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = _power(4 * docs.count(), (1 << SKETCH_BITS[0], 1 << SKETCH_BITS[1])).bit_length() - 1
    profiles = _profiles(docs, bits)
    sizes = profiles.where("chunk is null").select("doc_id", "n", "print")
    reps = sizes.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    # A node's rows: where one doc_id has several sets, the least of their nodes.
    nodes = written(sizes.where("n > 0 and doc_id is not null").join(reps, "print").select("doc_id", "rep").distinct(), "join-nodes")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _candidates(_postings(docs, _order(profiles, bits), buckets, split))

    def node(frame: DataFrame, col: str) -> DataFrame:
        to = nodes.select(F.col("doc_id").alias("_d"), F.col("rep").alias("_r"))
        return frame.join(to, frame[col] == to["_d"]).withColumn(col, F.col("_r")).drop("_d", "_r")

    leads = found.where("lead").select("list", "doc", "pos")
    front = leads.groupBy("list").agg(F.min_by("doc", F.struct("pos", "doc")).alias("a"))  # leads the parts of a dealt list
    pairs = found.where("a is not null").select("a", "b", "hits", "need")
    pairs = pairs.unionByName(leads.join(front, "list").select("a", F.col("doc").alias("b"), F.lit(SHARED).cast("long").alias("hits"), F.lit(0).cast("long").alias("need")))
    pairs = node(node(pairs, "a"), "b").where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"), F.sum("hits").alias("hits"), F.max("need").alias("need")).where("hits >= need").select("a", (F.col("low") + F.col("high") - F.col("a")).alias("b"))
    # Rows of one doc_id are one node.
    same = nodes.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").join(nodes.groupBy(F.col("doc_id").alias("a")).count().where("count > 1"), "a").select("a", "b")
    links = _verified(docs, _first_members(pairs)).unionByName(same)
    labels = components(links)
    lists = found.where("list is not null").groupBy("list", "doc").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))
    entries = node(lists, "doc").groupBy("list", "doc").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))

    def labelled(frame: DataFrame) -> DataFrame:
        known = labels.select(F.col("node").alias("_n"), "label")
        return frame.join(known, frame["doc"] == known["_n"], "left").select(*frame.columns, F.coalesce("label", "doc").alias("label"))

    mixed = written(_mixed_lists(labelled(entries), held), "join-mixed").drop("label", "main", "parts")
    if not mixed.isEmpty():
        # One doc_id may have several sets, and then no bitmap stands for it.
        maps = _bitmaps(docs, mixed.select("doc")).groupBy("doc").agg(F.min("bits").alias("low"), F.max("bits").alias("high"))
        maps = maps.select("doc", F.when(F.col("low") == F.col("high"), F.col("low")).alias("bits"))
        mixed = written(mixed.join(maps, "doc", "left"), "join-entries")
        for forest in (True, False):
            cross = written(_cross(_mixed_lists(labelled(mixed), held), forest), "join-across")
            if cross.isEmpty():
                break
            new = _verified(docs, _second_members(cross)).distinct()
            if not new.isEmpty():
                labels = written(merged(labels, new), "labels")
            # Where all pairs of the forests are links, what they left out lies in one component too.
            if forest and new.count() == cross.count():
                break
    best = sizes.where("doc_id is not null").join(reps, "print", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    out = best.join(labels, best["rep"] == labels["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    none = sizes.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: The same by brute force, for DuckDB.
ORACLE = r"""WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT x, y FROM edges UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other
), least_of AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id"""
