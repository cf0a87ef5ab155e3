"""Words of whole texts as arrays: Arrow splits and dictionary-encodes them, so per-word Python work is done once for each
distinct word of a slice."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a split at single spaces could part what one pattern match holds: white space before a space.
_RUNS = re.compile(r"\s ")
#: The same for Arrow, whose \s is ASCII only.
_ARROW_RUNS = r"[\t-\r\x1c-\x20\x{85}\pZ] "


@dataclass
class Words:
    """Distinct words of a slice, each document's words as indices into them, and each document's first index."""

    distinct: list[str]
    index: np.ndarray
    offsets: np.ndarray


def _encoded(flat: pa.Array, offsets: np.ndarray) -> Words:
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    coded = flat.dictionary_encode()
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), offsets)


def spaced(texts: pa.Array) -> Words:
    """Words by the rule [^\\x20\\x09-\\x0D]+ (ASCII white space parts them)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py() and len(flat):  # white space at the ends leaves empty words
        kept = keep.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lengths)), lengths)[kept]
        lengths = np.bincount(owner, minlength=len(lengths))
        flat = flat.filter(keep)
    return _encoded(flat, np.concatenate([[0], np.cumsum(lengths)]))


def segments(texts: pa.Array) -> Words:
    """Texts cut before each space: a cut is always a border between matches of a pattern whose words take one leading
    space, so each segment can be encoded by itself. A text with white space before a space, where that does not hold,
    is one segment as a whole."""
    odd = np.array([bool(_RUNS.search(t)) for t in texts.to_pylist()], bool)
    some = texts.filter(pa.array(~odd)) if odd.any() else texts
    parts = pc.split_pattern(some, " ")
    flat, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    first = np.zeros(len(flat), bool)
    first[(ends - lengths)[lengths > 0]] = True
    # Not the first of its text: with the space that stands before it. One "\x00"-free marker keeps both kinds apart.
    coded = flat.combine_chunks().dictionary_encode() if isinstance(flat, pa.ChunkedArray) else flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.unique(index[first])
    place = {int(i): len(names) + k for k, i in enumerate(heads)}
    distinct = [" " + w for w in names] + [names[i] for i in heads]
    index[first] = [place[int(i)] for i in index[first]]
    if not odd.any():
        return Words(distinct, index, np.concatenate([[0], ends]).astype(np.int64))
    whole = [t for t, o in zip(texts.to_pylist(), odd, strict=True) if o]
    base = len(distinct)
    pieces, counts, a, b = [], [], 0, 0
    starts = ends - lengths
    for o in odd:
        if o:
            pieces.append(np.array([base + b]))
            b += 1
        else:
            pieces.append(index[starts[a] : ends[a]])
            a += 1
        counts.append(len(pieces[-1]))
    return Words(distinct + whole, np.concatenate(pieces), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def coded_segments(texts: pa.Array, whole: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The segments of all texts end to end as one dictionary array, and each text's first place. A text that holds one of
    the strings `whole` is one segment too. All of it is done by Arrow."""
    odd = pc.match_substring_regex(texts, _ARROW_RUNS)
    for token in whole:
        odd = pc.or_(odd, pc.match_substring(texts, token))
    odd = odd.to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    cut, counts = parts.flatten(), np.ones(len(texts), np.int64)
    counts[~odd] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = np.zeros(len(cut), bool)
    lengths = counts[~odd]
    first[np.cumsum(lengths) - lengths] = True
    spaced_ = pc.binary_join_element_wise(pc.if_else(pa.array(first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), cut, pa.scalar("", pa.large_string()))
    if odd.any():
        from_whole = np.repeat(odd, counts)
        place = np.empty(len(from_whole), np.int64)
        place[~from_whole] = np.arange(len(cut))
        place[from_whole] = len(cut) + np.arange(int(odd.sum()))
        spaced_ = pa.concat_arrays([_one(spaced_), _one(texts.filter(pa.array(odd)))]).take(pa.array(place))
    return _one(spaced_).dictionary_encode(), starts


def _one(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def gathered(starts: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[starts[i]:starts[i + 1]] for each i of index, end to end; and the length of each."""
    lengths = (starts[1:] - starts[:-1])[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts[:-1][index] - (ends - lengths), lengths)
    return values[np.arange(total) + shift], lengths
