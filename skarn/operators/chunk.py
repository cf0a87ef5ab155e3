"""Line chunking. Fixed windows are sequence and slice expressions; the packing splitter, where each start depends on the
end before it, is an Arrow function over whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


def windows(max_tokens: int = 512, overlap: float = 0.25) -> tuple[int, int]:
    """(lines in a chunk, lines between starts)."""
    size = max(1, max_tokens // 4)
    return size, size - min(size - 1, int(size * overlap))


def line_chunks(files: DataFrame, size: int, step: int, *more: str) -> DataFrame:
    """relative_path, further columns, start_line, end_line, content, tokens of windows of `size` lines every `step`; blank ones go."""
    lines = files.select("relative_path", *more, F.split("content", "\n").alias("lines"))
    starts = lines.select("relative_path", *more, "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step))).alias("i"))
    part = F.array_join(F.slice("lines", F.col("i") + 1, F.lit(size)), "\n")
    out = starts.select("relative_path", *more, (F.col("i") + 1).alias("start_line"), F.least(F.size("lines"), F.col("i") + size).alias("end_line"), part.alias("content"))
    return out.where(F.col("content").rlike(r"\S")).withColumn("tokens", T.token_estimate(F.col("content")))


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with a header of scope and comment prefix before the content."""
    return chunks.withColumn("enriched", F.concat_ws("\n", F.concat(T.comment_prefix(F.col("language")), F.lit(" Scope: "), F.col("relative_path")), F.col("content")))


def split_lines(lines: list[str], most_chars: int, overlap: float) -> list[tuple[int, int]]:
    """(first, end) of greedy packs: lines are added while the pack stays under the limit, one at least; the next pack
    starts `overlap` of the last one's lines before its end."""
    out, start = [], 0
    while start < len(lines):
        end, total = start, 0
        while end < len(lines) and (end == start or total + len(lines[end]) + 1 <= most_chars):
            total += len(lines[end]) + 1
            end += 1
        out.append((start, end))
        if end >= len(lines):
            break
        start = max(start + 1, end - int((end - start) * overlap))
    return out


def packed_chunks(files: DataFrame, max_tokens: int = 512, overlap: float = 0.25) -> DataFrame:
    """relative_path, part, start_line, end_line, content of greedily packed chunks of at most max_tokens * 4 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("relative_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                rows += [(path, k, s + 1, e, "\n".join(lines[s:e])) for k, (s, e) in enumerate(split_lines(lines, 4 * max_tokens, overlap))]
            cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["relative_path", "part", "start_line", "end_line", "content"])

    return files.select("relative_path", "content").mapInArrow(run, "relative_path string, part int, start_line int, end_line int, content string")


def _header(columns: list[str], grounding: int) -> tuple[Column, Column]:
    """(what stands before the part's number, what stands after it from the second part on)."""
    mark = T.comment_prefix(F.col("language"))
    of = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    has = lambda c: F.when(c != "", c)
    symbol = has(F.concat_ws(" ", has(of("type")), has(of("name"))))
    doc = has(T.docstring_preview(of("docstring")))
    scope = F.when(has(of("scope")).isNotNull(), F.concat(mark, F.lit(" Scope: "), of("scope"), F.lit("\n")))
    lines = [scope, F.concat(mark, F.lit(" Symbol: "), symbol, F.lit("\n")), F.concat(mark, F.lit(" Doc: "), doc, F.lit("\n"))]
    first = F.concat(*[F.coalesce(x, F.lit("")) for x in lines], mark, F.lit(" Part: "))
    shown = F.transform(F.slice("_lines", 1, grounding), lambda x: F.when(x == "", mark).otherwise(F.concat(mark, F.lit(" "), x)))
    return first, F.concat(F.lit("\n"), mark, F.lit(" Grounding (start of symbol):\n"), F.array_join(shown, "\n")) if grounding > 0 else F.lit("")


def split_chunks(chunks: DataFrame, max_tokens: int = 512, overlap: float = 0.25, grounding: int = 6) -> DataFrame:
    """relative_path, part, start_line, end_line, name, content of large chunks (relative_path, language, content, and, where
    there are such columns, start_line, scope, type, name, docstring) in parts of at most 4 * max_tokens characters, one line
    at least.

    A part is a header, an empty line, and lines of the chunk. The header names scope, symbol, docstring and part, and from the
    second part on repeats the chunk's first `grounding` lines. A part shares `overlap` of its lines, one at least, with the
    next, unless it has one line only. Line offsets are running sums; where a part ends is a binary search among them, folded
    from part to part inside the row. Blank chunks, null ones too, have no parts."""
    ratio = 0.0 if overlap != overlap else max(0.0, min(0.9, overlap))
    own = written(chunks.where(F.col("content").rlike(r"\S")).withColumn("_id", F.monotonically_increasing_id()), "large-chunks")
    lines = own.select("_id", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("_id", "i", (F.length("line") + 1).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    offsets = lines.select("_id", "i", upto.alias("upto")).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("i", "upto"))).alias("o"))
    offsets = offsets.select("_id", F.concat(F.array(F.lit(0).cast("long")), F.transform("o", lambda x: x["upto"])).alias("_at"))
    first, more = _header(own.columns, grounding)
    rows = own.join(offsets, "_id").withColumn("_lines", F.split("content", "\n")).withColumns({"_first": first, "_more": more})
    n, at = F.size("_lines"), F.col("_at")
    room = lambda part: F.greatest(F.lit(0), 4 * max(1, max_tokens) - 2 - F.length("_first") - F.length((part + 1).cast("string")) - F.when(part > 0, F.length("_more")).otherwise(0))
    off = lambda i: F.element_at(at, (i + 1).cast("int"))

    def end_of(start: Column, part: Column) -> Column:
        def halved(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            fits = off(mid) - off(start) - 1 <= room(part)
            return F.when(s["lo"] >= s["hi"], s).when(fits, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (mid - 1).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct((start + 1).alias("lo"), n.alias("hi")), halved, lambda s: s["lo"])

    def cut(s: Column, _: Column) -> Column:
        def after(end: Column) -> Column:
            count = end - s["start"]
            shared = F.when(count > 1, F.least(F.greatest(F.lit(1), F.floor(count * ratio).cast("int")), count - 1)).otherwise(0)
            found = F.concat(s["cuts"], F.array(F.struct(s["part"].alias("part"), s["start"].alias("start"), end.alias("end"))))
            return F.struct(F.when(end >= n, n).otherwise(end - shared).alias("start"), (s["part"] + 1).alias("part"), found.alias("cuts"))

        # The end is bound to a variable, else each use would search again.
        return F.when(s["start"] >= n, s).otherwise(F.element_at(F.transform(F.array(end_of(s["start"], s["part"])), after), 1))

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("part"), F.array().cast("array<struct<part:int,start:int,end:int>>").alias("cuts"))
    parts = F.aggregate(F.sequence(F.lit(1), n), zero, cut, lambda s: s["cuts"])
    each = rows.withColumn("_c", F.explode(parts))
    body = F.array_join(F.slice("_lines", F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start")), "\n")
    text = F.concat("_first", (F.col("_c.part") + 1).cast("string"), F.when(F.col("_c.part") > 0, F.col("_more")).otherwise(""), F.lit("\n\n"), body)
    begin = F.col("start_line") if "start_line" in own.columns else F.lit(1)
    name = F.concat(F.col("name"), F.lit("_part"), F.col("_c.part").cast("string")) if "name" in own.columns else F.lit(None).cast("string")
    return each.select("relative_path", F.col("_c.part").alias("part"), (begin + F.col("_c.start")).cast("int").alias("start_line"), (begin + F.col("_c.end") - 1).cast("int").alias("end_line"), name.alias("name"), text.alias("content"))
