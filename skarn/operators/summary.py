"""A summary of source folders under a token budget: what matters most first, and a prefix of it that fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import small, written

# Files that a program or package starts from, and files that are none of its sources.
ENTRY = r"(^|/)(index|main|app)\.(ts|js)$"
TESTS = r"\.(test|spec)\.ts$"
#: Entry points, files that stand in where there are none, files whose exports are shown, exports of each, and leaves.
ENTRIES, FALLBACK, SHOWN, EXPORTS, LEAVES = 5, 3, 3, 10, 10
#: The order in which the parts of a summary are kept.
PARTS = ("architecture", "entry", "export", "leaf")


def _first(df: DataFrame, most: int, *order: str, by: str | list[str] = "scope") -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= most)


def dependencies(definitions: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, dst): files that call a name which one file alone defines."""
    owners = definitions.groupBy("name").agg(F.min("relative_path").alias("dst"), F.max("relative_path").alias("_m")).where("dst = _m").select("name", "dst")
    return sites.select("name", F.col("relative_path").alias("src")).distinct().join(owners, "name").where("src <> dst").select("src", "dst").distinct()


def summarized(files: DataFrame, definitions: DataFrame, edges: DataFrame, budget: int = 2000, scope: str = r"^([^/]+)/") -> DataFrame:
    """scope, part, n, text, tokens, upto, kept, within: the lines of each scope's summary in order of importance.

    scope: a pattern whose first group names the scope of a path; files without it have none and are left out. kept: the line
    and all before it fit the budget; within: the whole summary does. Entry points are files named like one, the first
    ENTRIES by path, or else FALLBACK other sources; exports are functions and classes of the first SHOWN of them by line."""
    definitions = definitions.select("relative_path", "name", "type", "start_line")
    own = files.select("relative_path", F.regexp_extract("relative_path", scope, 1).alias("scope")).where("scope <> ''").distinct()
    symbols = definitions.groupBy("relative_path").agg(F.count(F.lit(1)).alias("symbols"))
    out_, in_ = edges.groupBy(F.col("src").alias("relative_path")).agg(F.count(F.lit(1)).alias("uses")), edges.select(F.col("dst").alias("relative_path")).distinct().withColumn("used", F.lit(True))
    each = own.join(symbols, "relative_path", "left").join(out_, "relative_path", "left").join(in_, "relative_path", "left")
    return _lines(each, lambda shown: definitions.join(shown, "relative_path"), budget)


def outlined(outlines: DataFrame, budget: int = 2000, scope: str = r"^([^/]+)/") -> DataFrame:
    """`summarized` of files by their `xref.outlines`, with the dependencies that these show. The outlines are written, so each
    file is read once; what is known of a file comes together in one aggregation by path, written too."""
    outlines = written(outlines, "outlines")
    names = lambda c, path: outlines.select(F.col("relative_path").alias(path), F.explode(c).alias("name"))
    owners = names("defined", "path").groupBy("name").agg(F.min("path").alias("dst"), F.max("path").alias("_m")).where("dst = _m").select("name", "dst")
    edges = names("called", "src").join(owners, "name").where("src <> dst").select("src", "dst").distinct()
    end = lambda c, uses: F.struct(F.col(c).alias("relative_path"), F.lit(0).alias("symbols"), F.lit(uses).alias("uses"), F.lit(not uses).alias("used"))
    ends = edges.select(F.inline(F.array(end("src", 1), end("dst", 0))))
    own = outlines.select("relative_path", "symbols", F.lit(0).alias("uses"), F.lit(False).alias("used"))
    each = own.unionByName(ends).groupBy("relative_path").agg(F.sum("symbols").alias("symbols"), F.sum("uses").alias("uses"), F.max("used").alias("used"))
    each = each.select("relative_path", F.regexp_extract("relative_path", scope, 1).alias("scope"), "symbols", *[F.when(c, F.col(n)).alias(n) for n, c in (("uses", F.col("uses") > 0), ("used", F.col("used")))])
    each = written(each.where("scope <> ''"), "outlined-files")
    return _lines(each, lambda shown: outlines.select("relative_path", "first").join(small(shown), "relative_path").select("*", F.inline("first")).drop("first"), budget)


def _lines(each: DataFrame, exported: Callable[[DataFrame], DataFrame], budget: int) -> DataFrame:
    """The lines of files (relative_path, scope, symbols, uses, used; null for none). exported: the definitions of some files, with
    the columns that come with these."""
    own = each.select("relative_path", "scope")
    total = each.groupBy("scope").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count(F.when(F.col("used").isNull(), 1)).alias("roots"), F.count(F.when(F.col("uses").isNull(), 1)).alias("leaves"))
    line = F.format_string("files %d, symbols %d, dependencies %d, roots %d, leaves %d", "files", "symbols", "uses", "roots", "leaves")
    top = total.select("scope", F.lit(0).alias("p"), F.lit(1).alias("n"), line.alias("text"))

    named = own.where(F.col("relative_path").rlike(ENTRY))
    others = own.where(F.col("relative_path").rlike(r"\.ts$") & ~F.col("relative_path").rlike(TESTS)).join(named.select("scope").distinct(), "scope", "left_anti")
    entries = _first(named, ENTRIES, "relative_path").unionByName(_first(others, FALLBACK, "relative_path"))
    starts = entries.select("scope", F.lit(1).alias("p"), "n", F.col("relative_path").alias("text"))

    shown = entries.where(F.col("n") <= SHOWN).select("scope", "relative_path", F.col("n").alias("of"))
    exports = _first(exported(shown).where("type in ('function', 'class')"), EXPORTS, "start_line", "name", by=["scope", "relative_path"])
    exports = exports.select("scope", F.lit(2).alias("p"), (F.col("of") * (EXPORTS + 1) + F.col("n")).alias("n"), F.concat_ws(" ", "relative_path", F.concat_ws(":", "type", "name")).alias("text"))

    leaves = _first(each.where("uses is null"), LEAVES, "relative_path").select("scope", F.lit(3).alias("p"), "n", F.col("relative_path").alias("text"))
    lines = top.unionByName(starts).unionByName(exports).unionByName(leaves).withColumn("tokens", T.token_estimate(F.col("text")))
    w = Window.partitionBy("scope")
    upto = F.sum("tokens").over(w.orderBy("p", "n", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumns({"upto": upto, "total": F.sum("tokens").over(w)})
    return placed.select("scope", F.element_at(F.array(*map(F.lit, PARTS)), F.col("p") + 1).alias("part"), F.col("n").cast("int").alias("n"), "text", "tokens", "upto", (F.col("upto") <= budget).alias("kept"), (F.col("total") <= budget).alias("within"))
