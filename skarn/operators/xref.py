"""Cross references of source text with braces (the script languages and their like) and of text whose scopes are indentations.

A file is read once, from its first token to its last, by a small helper in Arrow tasks (`functions/scan.py`): what is written or
shuffled is definitions and call sites, never a row for each token. All between files is columns.

What counts: `function name(...) {`, `name(...) {` in a class body (with or without a result type), `const name = (...) => {`;
classes only give scope. Calls are `name(`, `x.name(` and `new name`; names that scripts have built in are left out. Without
types' arguments (`f<T>(x)`) and without arrow functions that have no braces. Text in strings and comments is none; a bracket
that is never closed reaches to the end of its file.

Defined cases: a null content has no tokens; each row is a file by itself, so paths should be distinct.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as T
from ..sources.shared import written

NOISE = frozenset(T.BUILTIN_NAMES)
DEFINITIONS = pa.struct([("name", pa.string()), ("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("fqn", pa.string()), ("calls", pa.list_(pa.string()))])
SITES = pa.struct([("i", pa.int32()), ("name", pa.string()), ("line", pa.int32()), ("receiver", pa.string()), ("caller", pa.string())])
ENCLOSED = pa.struct([("line", pa.int32()), ("name", pa.string()), ("caller", pa.string())])
DOCS = pa.struct([("name", pa.string()), ("line", pa.int32()), ("doc", pa.string()), ("defines", pa.bool_())])
IMPORTS = pa.struct([("module", pa.string()), ("line", pa.int32())])
STATEMENTS = pa.struct([("words", pa.list_(pa.string())), ("line", pa.int32())])
FIRST = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("start_line", pa.int32())]))
OUTLINES = pa.struct([("symbols", pa.int32()), ("defined", pa.list_(pa.string())), ("called", pa.list_(pa.string())), ("first", FIRST)])
#: Spark's names of the types above.
NAMES = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", FIRST: "array<struct<name: string, type: string, start_line: int>>"}
#: Characters of source text whose rows are made at once.
SLICE = 1 << 20
#: Distinct links that a task keeps before it gives them on.
LINKED = 1 << 19


@contextlib.contextmanager
def _no_cycles() -> Iterator[None]:
    """No search for cycles meanwhile: the scan makes many tuples and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _rows(files: DataFrame, of: Callable[[str], list[tuple]], row: pa.StructType) -> DataFrame:
    """relative_path and a row for each tuple that `of` gives of a content."""
    schema = pa.schema([("relative_path", pa.string()), *row])

    def block(paths, rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(row)
        return pa.record_batch([pa.array(paths, pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, row, strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_cycles():
            for batch in batches:
                paths, rows, size = [], [], 0
                for path, content in zip(batch["relative_path"], batch["content"], strict=True):
                    if (text := content.as_py()) is None:
                        continue
                    own = of(text)
                    paths += [path.as_py()] * len(own)
                    rows += own
                    if (size := size + len(text)) > SLICE:
                        yield block(paths, rows)
                        paths, rows, size = [], [], 0
                yield block(paths, rows)

    out = ", ".join(f"{f.name} {NAMES[f.type]}" for f in schema)
    return files.select(F.col("relative_path").cast("string").alias("relative_path"), "content").mapInArrow(run, out)


def _references(files: DataFrame, read: Callable[[str, frozenset], tuple], by_class: bool) -> tuple[DataFrame, DataFrame]:
    defs = _rows(files, lambda text: scan.placed(*read(text, NOISE), by_class, False), DEFINITIONS)
    sites = _rows(files, lambda text: scan.placed(*read(text, NOISE), by_class, True), SITES)
    # Names hold no dots.
    return defs.select("relative_path", "name", "type", "start_line", "end_line", F.split("fqn", "[.]").alias("scope"), "fqn", "calls"), sites


def references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, call sites) of files (relative_path, content), both lazy: who asks for one pays for one, and nothing is
    written in between.

    definitions: relative_path, name, type, start_line, end_line, scope, fqn, calls (distinct, also those of definitions
    inside). sites: relative_path, i, name, line, receiver, caller (the innermost definition's fqn, or module)."""
    return _references(files, scan.scan, False)


def indented_references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`references` of source text whose scopes are indentations. A function directly in a class is a method. A tab counts as one
    blank; a definition that does not begin its logical line is none."""
    return _references(files, scan.indented_scan, True)


def enclosed(files: DataFrame, read: Callable[[str, frozenset], tuple] = scan.scan) -> DataFrame:
    """relative_path, line, name, caller of each distinct call on a line that a definition's lines hold: `graph.enclosing` of
    files' own calls and definitions. Both lie in one file, so they meet where it is read, once and without a shuffle.
    read: `scan.indented_scan` for text whose scopes are indentations."""
    return _rows(files, lambda text: scan.outermost(*read(text, NOISE)), ENCLOSED)


def links(files: DataFrame, read: Callable[[str, frozenset], tuple] = scan.scan) -> DataFrame:
    """link: what defines and what calls each name in all files, as `scan.linked` writes it. Each file is read once for both.
    Equal rows of a task are one as long as it keeps them, so they need not be distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        with _no_cycles():
            for batch in batches:
                for content in batch["content"]:
                    if (text := content.as_py()) is not None:
                        seen |= scan.linked(*read(text, NOISE))
                    if len(seen) >= LINKED:
                        yield pa.record_batch([pa.array(seen, pa.string())], names=["link"])
                        seen = set()
            yield pa.record_batch([pa.array(seen, pa.string())], names=["link"])

    return files.select("content").mapInArrow(run, "link string")


def outlines(files: DataFrame, most: int) -> DataFrame:
    """relative_path, symbols, defined, called, first: a row for each file, read once (`scan.outline`). A null content has none of
    these, and a row too."""
    return _rows(files.withColumn("content", F.coalesce("content", F.lit(""))), lambda text: [scan.outline(*scan.scan(text, NOISE), most)], OUTLINES)


def imports(files: DataFrame) -> DataFrame:
    """relative_path, module, line of `import ... from "m"`, `export ... from "m"`, `import "m"`, `import("m")`, `require("m")`."""
    return _rows(files, scan.imported, IMPORTS)


def indented_imports(files: DataFrame) -> DataFrame:
    """relative_path, module, line of `import a.b, c` and `from .m import x`."""
    own = _rows(files, scan.indented_imported, STATEMENTS)
    cut = F.array_position("words", "import").cast("int")
    module = F.array_join(F.slice("words", 2, F.greatest(cut - 2, F.lit(0))), "")
    listed = F.transform(F.split(F.array_join(F.slice("words", 2, F.size("words")), " "), " , "), lambda x: F.replace(F.regexp_extract(x, r"^(.*?)(?: as .*)?$", 1), F.lit(" "), F.lit("")))
    return own.select("relative_path", F.explode(F.when(F.col("words")[0] == "from", F.array(module)).otherwise(listed)).alias("module"), "line")


def docstrings(files: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """relative_path, name, line, doc: the comment that stands before a definition, with nothing but modifiers between them;
    definitions without one have no row. definitions (relative_path, name, start_line): those of another reading of the files;
    without them the files' own, which are found on the way and need no join."""
    near = _rows(files, lambda text: scan.commented(text, NOISE), DOCS)
    if definitions is None:
        return near.where("defines").drop("defines")
    own = definitions.select("relative_path", "name", F.col("start_line").alias("line")).distinct()
    return own.join(near.drop("defines"), ["relative_path", "name", "line"]).dropDuplicates(["relative_path", "name", "line"])


def parsed_once(files: DataFrame, strategy: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = references) -> tuple[DataFrame, DataFrame]:
    """What a strategy gives, with each distinct content read once; files that share it share what was found. A content is kept
    by its hash and shuffled once; the paths that share it are written beside it."""
    keyed = files.select("relative_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("_hash"))
    paths = written(keyed.select("_hash", "relative_path"), "parse-keys")
    once = keyed.dropDuplicates(["_hash"]).select(F.col("_hash").alias("relative_path"), "content")
    spread_ = lambda df: df.withColumnRenamed("relative_path", "_hash").join(paths, "_hash").select(df.columns)
    defs, sites = strategy(once)
    return spread_(defs), spread_(sites)


#: How a name is resolved, best first.
LEVELS = ("qualified", "name", "any case")


def resolved(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """query, level, fqn, relative_path of the definitions that each name (query) means: those of that qualified name; where
    there are none, those of that name; where there are none, those in any case.

    Definitions are made once and written. What a name's level is shows from their distinct names alone; then each level is an
    equal join of its own names, none of them skewed by the others."""
    defs = written(definitions.select("relative_path", "name", "fqn").distinct(), "definitions")
    last = F.substring_index("query", ".", -1)
    keys = ((F.col("query"), F.col("fqn")), (last, F.col("name")), (F.lower(last), F.lower("name")))
    asked, level = names.select("query").where("query is not null").distinct(), F.lit(None).cast("int")
    for i, (q, d) in enumerate(keys):
        asked = asked.withColumn("_k", q).join(defs.select(d.alias("_k"), F.lit(True).alias(f"_{i}")).distinct(), "_k", "left").drop("_k")
        level = F.coalesce(level, F.when(F.col(f"_{i}"), i))
    asked, out = written(asked.select("query", level.alias("_level")).where("_level is not null"), "resolved-names"), None
    for i, (q, d) in enumerate(keys):
        own = asked.where(F.col("_level") == i).select("query", q.alias("_k"))
        found = own.join(defs.withColumn("_k", d), "_k").select("query", F.lit(LEVELS[i]).alias("level"), "fqn", "relative_path")
        out = found if out is None else out.unionByName(found)
    return out
