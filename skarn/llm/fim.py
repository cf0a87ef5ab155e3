"""Fill-in-middle transformation by a sparse checkpoint index.

A text is read once, as UTF-8 bytes in blocks, to count its units (a word with the white space before it; white space at the
end is a unit of its own). While counting, the byte and code-point offset of every EVERY-th unit's end is recorded. A cut after
a number of units is a binary search among these checkpoints and a short rescan from there. The index takes 24 bytes for
EVERY units, so the longest text costs little more than itself.

The cuts and the form come from SHA-256 of SEED and the id alone, so reruns and equal rows agree.

Defined cases: a null text counts as empty; an empty text, one that holds a marker, and the share that PLAIN leaves are plain:
the output is the text, the lengths are null. A null id hashes as the empty string. Equal ids with other texts draw the same
numbers. Columns of the input that are named like a result (n, form, prefix_chars, middle_chars, output) go, whatever their
case; all others are carried.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, slices, table, tidy

#: Units between two checkpoints.
EVERY = 512
#: Bytes looked at together while counting, and while rescanning from a checkpoint.
BLOCK, STEP = 1 << 20, 1 << 12
#: Per cent of texts that are cut, and of those that are cut as suffix, prefix, middle.
CUT, SPM = 50, 80
SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Checkpoints:
    """Units of a text and where every EVERY-th of them ends."""

    def __init__(self, data: bytes | memoryview, every: int = EVERY, block: int = BLOCK):
        self.data = np.frombuffer(data, np.uint8)
        self.every = every
        self.units: list[int] = [0]
        self.at: list[int] = [0]
        self.points: list[int] = [0]
        units = points = 0
        for start in range(0, len(self.data), block):
            part = self.data[start : start + block]
            ends = self._ends(start, len(part))
            starts = (part & 0xC0) != 0x80  # bytes that begin a code point
            for e in ends[(every - 1 - units) % every :: every].tolist():
                known = self.at[-1] - start
                here = points + int(np.count_nonzero(starts[:e])) if known <= 0 else self.points[-1] + int(np.count_nonzero(starts[known:e]))
                self.units.append(self.units[-1] + every)
                self.at.append(start + e)
                self.points.append(here)
            units += len(ends)
            points += int(np.count_nonzero(starts))
        self.total_points = points
        self.n = units + bool(len(self.data) and _SPACE[self.data[-1]])

    def _ends(self, start: int, size: int) -> np.ndarray:
        """Where units end among `size` bytes from start on, counted from start; white space at the end of the text apart."""
        space = _SPACE[self.data[start : start + size + 1]]
        last = np.ones(1, bool) if start + size >= len(self.data) else np.zeros(0, bool)
        space = np.concatenate([space, last])
        return np.flatnonzero(~space[:-1] & space[1:]) + 1

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first k units."""
        if k >= self.n:
            return len(self.data), self.total_points
        i = bisect.bisect_right(self.units, k) - 1
        left, at, points = k - self.units[i], self.at[i], self.points[i]
        while left:
            size = min(STEP, len(self.data) - at)
            ends = self._ends(at, size)
            to = at + (int(ends[left - 1]) if left <= len(ends) else size)
            points += int(np.count_nonzero((self.data[at:to] & 0xC0) != 0x80))
            left -= min(left, len(ends))
            at = to
        return at, points


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: int | None, text: str, cut: int = CUT, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    data = text.encode()
    index = Checkpoints(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, text
    ends = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_points), (b, b_points) = map(index.cut, ends)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    form = "spm" if h4 % 100 < spm else "psm"
    out = [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if form == "spm" else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return index.n, form, a_points, b_points - a_points, "".join(out)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """df's columns and n, form, prefix_chars, middle_chars, output. One pass, no shuffle."""
    more = [x.split()[0] for x in RESULTS.split(", ")]
    names = [c for c in df.columns if c.lower() not in more]
    schema = extended(df, RESULTS, names)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                rows = [transformed(i, t or "", cut, spm, seed) for i, t in zip(b.column(id_col).to_pylist(), b.column(text_col).to_pylist(), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *cols], [*names, *more])
        tidy()

    return df.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. No piece of a cut text holds a marker, so each is where it first stands."""
    at = lambda marker: F.locate(marker, output)
    between = lambda marker, end: F.substring(output, at(marker) + len(marker), at(end) - at(marker) - len(marker))
    after = F.substring(output, at(MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents
), d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, [CAST(concat('0x', substr(h, 1 + 8 * i, 8)) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM t
), f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
