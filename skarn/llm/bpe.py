"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece's leaves hold the rank of the pair that starts at each live byte position; each inner node holds the smaller rank
of its halves, the left one on a tie, so the root names the leftmost pair of the least rank. A merge kills one position and
changes the pairs of the merged node and its live left neighbour: two point updates, logarithmic in the piece's length.
Pieces of like length are kept in one array and merged in step, one merge for each live piece at a time.

Defined cases: a null text reads as empty and has no ids; the sha256 of no ids is that of the empty string; a very long
piece (no white space at all) is one row of a deeper tree; equal texts are encoded alike. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text, slices, table, tidy
from .words import gathered, segments

_NONE = np.int32(2**31 - 1)
#: Bytes of text encoded at once; its ids and their spellings take some 20 times as much.
SLICE = 1 << 20
#: Leaves of the trees that are merged in step, one piece at least; a leaf takes some 50 bytes.
CELLS = 1 << 17
#: Leaves from which a piece is merged by itself: a step for few trees costs more than the steps of one.
LONG = 1 << 11


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class SegmentTreeBPE:
    """Encoder and decoder for one table of ranks and one pattern. Remembers pieces, and forgets all of them
    once there are more than `memory`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 50_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        # Open addressing in arrays: a slot's key and rank; a key sits within `probes` slots of its hash.
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs))))) + 2)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.pair_keys, self.pair_ranks, self.probes = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, _NONE, np.int32), 0
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left] + self.probes
            free = self.pair_keys[at] < 0
            self.pair_keys[at[free][::-1]] = keys[left[free][::-1]]
            won = self.pair_keys[at] == keys[left]
            self.pair_ranks[at[won]] = values[left[won]]
            left, self.probes = left[~won], self.probes + 1
        token = [b""] * self.size
        for t, r in ranks.items():
            token[r] = t
        self.token_starts = np.concatenate([[0], np.cumsum([len(t) for t in token])])
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        text = [str(i).encode() + b" " for i in range(self.size)]
        self.text_starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        """Drops the remembered pieces."""
        self.known, self.starts, self.values = {}, np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it does not merge."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        found = np.where(self.pair_keys[slot] == keys, self.pair_ranks[slot], _NONE)
        for p in range(1, self.probes):
            at = np.flatnonzero((found == _NONE) & (self.pair_keys[slot + p - 1] >= 0))
            if not len(at):
                break
            hit = self.pair_keys[slot[at] + p] == keys[at]
            found[at[hit]] = self.pair_ranks[slot[at[hit]] + p]
        return found

    def _merge(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """ids: (pieces, width) of byte ids, width a power of two. Merges all pieces; dead positions hold -1.
        A node holds rank * width + position, so the smaller value is the smaller rank, or its leftmost place."""
        n, width = ids.shape
        none = np.int64(int(_NONE) * width)
        spots = np.arange(width)
        tree = np.full((n, 2 * width), none, np.int64)
        if width > 1:
            r, c = np.nonzero(spots[:-1] < lengths[:, None] - 1)
            tree[r, width + c] = self._rank(ids[r, c], ids[r, c + 1]).astype(np.int64) * width + c
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        after = np.where(spots + 1 < lengths[:, None], spots + 1, width).astype(np.int32).reshape(-1)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        tree, flat = tree.reshape(-1), ids.reshape(-1)
        rows = np.flatnonzero(tree[1 :: 2 * width] < none)
        while len(rows):
            base, top = rows * width, rows * (2 * width)
            least = tree[top + 1]
            at = least % width
            here = base + at
            gone = after[here]
            made = (least // width).astype(np.int32)
            flat[here] = made  # a pair's rank is the id of the token that it makes
            flat[base + gone] = -1
            nxt = after[base + gone].astype(np.int64)
            after[here] = nxt
            some = np.flatnonzero(nxt < width)
            before[base[some] + nxt[some]] = at[some]
            new = np.full(len(rows), none, np.int64)
            new[some] = self._rank(made[some], flat[base[some] + nxt[some]]).astype(np.int64) * width + at[some]
            prev = before[here].astype(np.int64)
            had = np.flatnonzero(prev >= 0)
            prev = prev[had]
            tree[top + width + at] = new
            tree[top + width + gone] = none
            tree[top[had] + width + prev] = self._rank(flat[base[had] + prev], made[had]).astype(np.int64) * width + prev
            for up, node in ((top, (width + at) >> 1), (top, (width + gone) >> 1), (top[had], (width + prev) >> 1)):
                for _ in range(width.bit_length() - 1):
                    pair = up + 2 * node
                    tree[up + node] = np.minimum(tree[pair], tree[pair + 1])
                    node = node >> 1
            rows = rows[tree[top + 1] < none]
        return ids

    @cached_property
    def _pairs(self) -> dict[int, int]:
        """Rank by pair, for pieces that are merged by themselves."""
        used = self.pair_keys >= 0
        return dict(zip(self.pair_keys[used].tolist(), self.pair_ranks[used].tolist(), strict=True))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: the same tree, with a walk up from each changed leaf that ends where nothing changes."""
        n = len(piece)
        width, size, rank_of = 1 << (n - 1).bit_length(), self.size, self._pairs.get
        first, none = self.byte[np.frombuffer(piece, np.uint8)], int(_NONE) * width
        nodes = np.full(2 * width, none, np.int64)
        nodes[width : width + n - 1] = self._rank(first[:-1], first[1:]).astype(np.int64) * width + np.arange(n - 1)
        level = width // 2
        while level:
            np.minimum(nodes[2 * level : 4 * level : 2], nodes[2 * level + 1 : 4 * level : 2], out=nodes[level : 2 * level])
            level //= 2
        tree, ids = array("q", nodes.tobytes()), array("i", first.astype(np.int32).tobytes())
        del nodes
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = width + place
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (least := tree[1]) < none:
            made, at = divmod(least, width)
            gone = after[at]
            nxt = after[gone]
            ids[at], ids[gone], after[at] = made, -1, nxt
            put(gone, none)
            if nxt < n:
                before[nxt] = at
                rank = rank_of(made * size + ids[nxt])
                put(at, none if rank is None else rank * width + at)
            else:
                put(at, none)
            prev = before[at]
            if prev >= 0:
                rank = rank_of(ids[prev] * size + made)
                put(prev, none if rank is None else rank * width + prev)
        out = np.frombuffer(ids, np.int32)
        return out[out >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): the ids of each piece (a match of the pattern, as UTF-8) end to end."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        counts = (whole >= 0).astype(np.int64)
        todo = np.flatnonzero((whole < 0) & (lengths > 0))
        widths = np.left_shift(1, np.ceil(np.log2(lengths[todo])).astype(np.int64))
        parts = []
        for width in np.unique(widths).tolist():
            members = todo[widths == width]
            if width >= LONG:
                for i in members.tolist():
                    ids = self._merge_long(pieces[i])
                    counts[i] = len(ids)
                    parts.append((np.array([i]), ids))
                continue
            most = max(1, CELLS // width)
            for k in range(0, len(members), most):
                some = members[k : k + most]
                size = lengths[some]
                ids = np.full((len(some), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                ids = self._merge(ids, size)
                kept = ids >= 0
                counts[some] = kept.sum(1)
                parts.append((some, ids[kept]))
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(starts[-1]), np.int32)
        single = np.flatnonzero(whole >= 0)
        out[starts[single]] = whole[single]
        for some, ids in parts:
            n = counts[some]
            out[np.arange(len(ids)) + np.repeat(starts[some] - (np.cumsum(n) - n), n)] = ids
        return starts, out

    def encode_segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): ids of each text end to end. Distinct pieces that are not yet known are merged together."""
        if len(self.known) > self.memory:
            self.forget()
        known = self.known
        place, counts, new = [], [], []
        for t in texts:
            # A space and letters are one match of the pattern; everything else is left to it.
            for p in (t,) if t[1:].isalpha() and (t[0] == " " or t[0].isalpha()) else self.pattern.findall(t):
                at = known.get(p)
                if at is None:
                    at = known[p] = len(known)
                    new.append(p)
                place.append(at)
            counts.append(len(place))
        if new:
            starts, ids = self.encode_pieces([p.encode() for p in new])
            self.starts = np.concatenate([self.starts, starts[1:] + self.starts[-1]])
            self.values = np.concatenate([self.values, ids])
        ids, lengths = gathered(self.starts, self.values, np.array(place, np.int64))
        return np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.array(counts, np.int64)])], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids) of a large_string array: the ids of all texts end to end."""
        words = segments(texts)
        starts, values = self.encode_segments(words.distinct)
        ids, lengths = gathered(starts, values, words.index)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return upto[words.offsets], ids

    def decode(self, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, bytes) of the token bytes of each list of ids."""
        return self._spelled(self.token_starts, self.token_bytes, starts, ids)

    def decimals(self, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, bytes) of the ids in decimal, one space after each."""
        return self._spelled(self.text_starts, self.text_bytes, starts, ids)

    @staticmethod
    def _spelled(own: np.ndarray, values: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(values)]).take(pa.array(ids))
        buffers = spelled.buffers()
        at = np.frombuffer(buffers[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        return at[starts], np.frombuffer(buffers[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> SegmentTreeBPE:
    """One coder for each worker."""
    return SegmentTreeBPE(read_ranks(path), pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids with keep_ids) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                starts, ids = c.encode(plain_text(b.column("text")))
                d_at, decoded = c.decode(starts, ids)
                t_at, text = c.decimals(starts, ids)
                n = b.num_rows
                cols = [
                    b.column("id"), pa.array(np.diff(starts)),
                    pa.array([hashlib.sha256(text[t_at[i] : max(t_at[i], t_at[i + 1] - 1)]).hexdigest() for i in range(n)]),
                    pa.array([hashlib.sha256(decoded[d_at[i] : d_at[i + 1]]).hexdigest() for i in range(n)]),
                ]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)
        c.forget()  # the worker lives on
        tidy()

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the public table of 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), *public_ranks())
