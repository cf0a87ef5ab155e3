"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame and SQL functions only.

Targets: the weights share all words; what exceeds three times a source's own words is shared anew among the others
(closed form: the level is the largest of (words left) / (weight left) along the sources by cap per weight).
Quotas: blocks of BLOCK words go to sources by highest quotients target / (2k - 1), then each source's blocks go to groups of
its shards, and a group's to the shards, the same way by size. Only quotients near the fair share are listed: a seat count of a divisor method lies
within half the number of parties of it, scaled, so the list is linear in the number of parties.
Selection: whole passes over a shard's documents first, then blocks in seeded hash order up to the shard's quota.

A shard holds about SHARD_WORDS words of one source, so a source with a third of all rows is many window groups.
Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated
rows are documents of their own; equal quotients go to the source, shard or seat of the lower number and equal draws to the
smaller id; a very long text is many blocks of one document; an empty table gives an empty result. Blocks are equal but for a
document's last. `mix` reads id, source and text alone; `mixed` carries all columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Words in a block.
BLOCK = 32
#: Words of a source in a shard, about.
SHARD_WORDS = 1 << 18
#: Shards of a source whose seats are dealt together.
GROUPED = 1024
#: A source gives at most so many times its words, and so does a document.
MOST = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"

# {HASH(x)}, {SERIES a, b} and {DIV a, b} differ between the dialects.
_QUOTA = """src AS (
  SELECT source, sum(size) AS own, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM sized GROUP BY source
), cap AS (
  SELECT source, CAST(own AS BIGINT) AS own, rnk, CAST(1 + (rnk - 1) % 3 AS DOUBLE) AS w FROM src
), lev AS (
  SELECT (CAST(sum(own) OVER () AS DOUBLE)
     - coalesce(sum(CAST({MOST} * own AS DOUBLE)) OVER (ORDER BY {MOST} * own / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY {MOST} * own / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap
), tgt AS (
  SELECT source, own, rnk, least(CAST({MOST} * own AS DOUBLE), w * (SELECT max(level) FROM lev)) AS target FROM cap
), tot AS (
  SELECT CAST(sum(own) AS DOUBLE) AS words, count(*) AS n, floor(sum(own) / {BLOCK}.0e0) AS seats FROM tgt
), fair AS (
  SELECT source, own, rnk, target, n, tot.seats AS all_seats, CASE WHEN words > 0 THEN target * tot.seats / words ELSE 0 END AS q FROM tgt CROSS JOIN tot
), sure AS (
  SELECT *, CASE WHEN all_seats > 0 THEN ceil(q * n / (2 * all_seats)) + 2 ELSE 0 END AS near FROM fair
), low AS (
  SELECT *, CAST(greatest(0, floor(q) - near) AS BIGINT) AS base, CAST(floor(q) + near AS BIGINT) AS top FROM sure
), quot AS (
  SELECT rnk, target, {SERIES(base + 1, top + 1)} AS seat FROM low WHERE all_seats > 0
), won AS (
  SELECT rnk, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, rnk, seat) AS place FROM quot
), extra AS (
  SELECT rnk, count(*) AS more FROM won WHERE place <= (SELECT max(all_seats) - sum(base) FROM low) GROUP BY rnk
), quota AS (
  SELECT low.rnk, low.source, low.own, low.target, low.base + coalesce(extra.more, 0) AS seats,
    CAST(greatest(1, ceil(low.own / {SHARD_WORDS}.0e0)) AS BIGINT) AS shards FROM low LEFT JOIN extra ON low.rnk = extra.rnk
)"""
_DOC = """doc AS (
  SELECT d.doc_id, d.source, d.copy, d.size, q.rnk, {HASH(concat(coalesce(CAST(d.doc_id AS VARCHAR), ''), ':', CAST(d.size AS VARCHAR), ':', CAST(d.copy AS VARCHAR)))} % q.shards AS shard
  FROM sized AS d JOIN quota AS q ON d.source IS NOT DISTINCT FROM q.source
)"""
# A party's seats go to its members by highest quotients words / (2k - 1). Only quotients near the fair share are listed.
_LEVEL = """{P}fair AS (
  SELECT m.rnk, m.{GROUP} AS grp, m.{MEMBER} AS member, m.words, p.seats, CASE WHEN p.words > 0 THEN CAST(m.words AS DOUBLE) * p.seats / p.words ELSE 0 END AS q, count(*) OVER (PARTITION BY m.rnk, m.{GROUP}) AS n
  FROM {MEMBERS} AS m JOIN {PARTIES} AS p ON m.rnk = p.rnk AND m.{GROUP} = p.grp WHERE p.seats > 0
), {P}low AS (
  SELECT *, CAST(greatest(0, floor(q) - ceil(q * n / (2 * seats)) - 2) AS BIGINT) AS base, CAST(floor(q) + ceil(q * n / (2 * seats)) + 2 AS BIGINT) AS top FROM {P}fair
), {P}quot AS (
  SELECT rnk, grp, member, words, seats, sum(base) OVER (PARTITION BY rnk, grp) AS given, base, top FROM {P}low
), {P}won AS (
  SELECT rnk, grp, member, seats - given AS free, row_number() OVER (PARTITION BY rnk, grp ORDER BY words / (2 * seat - 1.0e0) DESC, member, seat) AS place
  FROM (SELECT rnk, grp, member, words, seats, given, {SERIES(base + 1, top + 1)} AS seat FROM {P}quot) x
), {P}extra AS (
  SELECT rnk, grp, member, count(*) AS more FROM {P}won WHERE place <= free GROUP BY rnk, grp, member
), {P}seats AS (
  SELECT l.rnk, l.grp AS above, l.member AS grp, l.words, l.base + coalesce(e.more, 0) AS seats
  FROM {P}low l LEFT JOIN {P}extra e ON l.rnk = e.rnk AND l.grp = e.grp AND l.member = e.member
)"""


def _level(prefix: str, members: str, group: str, member: str, parties: str) -> str:
    for k, v in {"P": prefix, "MEMBERS": members, "GROUP": group, "MEMBER": member, "PARTIES": parties}.items():
        _text = _LEVEL if k == "P" else _text
        _text = _text.replace("{" + k + "}", v)
    return _text


# A source's seats go to groups of GROUPED shards, and a group's to its shards, so no task orders all shards of a source.
_PLAN = """cell AS (
  SELECT rnk, CAST({DIV(shard, {GROUPED})} AS BIGINT) AS grp, shard, CAST(sum(size) AS BIGINT) AS words FROM doc GROUP BY rnk, shard HAVING sum(size) > 0
), gcell AS (
  SELECT rnk, CAST(0 AS BIGINT) AS grp, grp AS member, CAST(sum(words) AS BIGINT) AS words FROM cell GROUP BY rnk, grp
), whole AS (
  SELECT rnk, CAST(0 AS BIGINT) AS grp, own AS words, seats FROM quota
), """ + _level("g", "gcell", "grp", "member", "whole") + ", " + _level("c", "cell", "grp", "shard", "gseats") + """, cquota AS (
  SELECT rnk, grp AS shard, words, least(seats * {BLOCK}, {MOST} * words) AS want FROM cseats
), plan AS (
  SELECT rnk, shard, {DIV(want, words)} AS passes, want - {DIV(want, words)} * words AS rest FROM cquota
)"""
_DRAW = """block AS (
  SELECT d.rnk, d.shard, d.doc_id, d.size, d.copy, d.block, least({BLOCK}, d.size - {BLOCK} * d.block) AS words, p.rest,
    {HASH(concat(coalesce(CAST(d.doc_id AS VARCHAR), ''), ':', CAST(d.size AS VARCHAR), ':', CAST(d.copy AS VARCHAR), ':', CAST(d.block AS VARCHAR), ':{SEED}'))} AS h
  FROM (SELECT *, {SERIES(CAST(0 AS BIGINT), {DIV(size - 1, {BLOCK})})} AS block FROM doc WHERE size > 0) d JOIN plan AS p ON d.rnk = p.rnk AND d.shard = p.shard WHERE p.rest > 0
), drawn AS (
  SELECT rnk, doc_id, size, copy, block, least(words, rest - (sum(words) OVER (PARTITION BY rnk, shard ORDER BY h, doc_id, size, copy, block ROWS UNBOUNDED PRECEDING) - words)) AS got FROM block
), part AS (
  SELECT rnk, doc_id, size, copy, sum(got) AS got{PIECES} FROM drawn WHERE got > 0 GROUP BY rnk, doc_id, size, copy
)
SELECT doc.doc_id, doc.size, qt.own AS source_size, qt.target,
  CAST(coalesce(pl.passes, 0) * doc.size + coalesce(part.got, 0) AS BIGINT) AS taken{MORE}
FROM doc JOIN quota AS qt ON doc.rnk = qt.rnk
LEFT JOIN plan AS pl ON doc.rnk = pl.rnk AND doc.shard = pl.shard
LEFT JOIN part ON part.rnk = doc.rnk AND part.doc_id IS NOT DISTINCT FROM doc.doc_id AND part.size = doc.size AND part.copy = doc.copy
"""


def _argument(sql: str, name: str, make) -> str:
    """Replaces each {NAME(a, b)} by make(a, b)."""
    while (at := sql.rfind("{" + name + "(")) >= 0:
        i, depth, args = at + len(name) + 2, 1, [""]
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 1 and sql[i] == ",":
                args.append("")
            elif depth:
                args[-1] += sql[i]
            i += 1
        sql = sql[:at] + make(*map(str.strip, args) if name != "HASH" else [",".join(args)]) + sql[i + 1 :]
    return sql


def dialect(sql: str, duckdb: bool, **values: object) -> str:
    """The SQL text for Spark or DuckDB."""
    for k, v in values.items():
        sql = sql.replace("{" + k + "}", str(v))
    if duckdb:
        sql = _argument(sql, "HASH", lambda x: f"CAST(concat('0x', substr(md5({x}), 1, 15)) AS BIGINT)")
        sql = _argument(sql, "SERIES", lambda a, b: f"unnest(generate_series({a}, {b}))")
        return _argument(sql, "DIV", lambda a, b: f"(({a}) // ({b}))")
    sql = _argument(sql, "HASH", lambda x: f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)")
    sql = _argument(sql, "SERIES", lambda a, b: f"explode(sequence({a}, {b}))")
    return _argument(sql, "DIV", lambda a, b: f"(({a}) div ({b}))").replace("VARCHAR", "STRING")


def _values(pieces: bool) -> dict[str, object]:
    return {
        "BLOCK": BLOCK, "GROUPED": GROUPED, "SHARD_WORDS": SHARD_WORDS, "MOST": MOST, "SEED": SEED,
        "PIECES": ", collect_list(struct(block, got)) AS pieces" if pieces else "",
        "MORE": ", doc.source, doc.copy, CAST(coalesce(pl.passes, 0) AS INT) AS passes, part.pieces" if pieces else "",
    }


def sized(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size and copy (tells repeated rows apart), written once: the text is read once only."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    each = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return written(each.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")), "mix-sizes")


def mix(sizes: DataFrame, pieces: bool = False) -> DataFrame:
    """The mix of `sized` rows: doc_id, size, source_size, target, taken; with `pieces` also source, copy, passes (whole copies)
    and pieces, an array of (block, words got) of the last, partial pass."""
    spark = sizes.sparkSession

    def run(*parts: str, select: str = "", **tables: DataFrame) -> DataFrame:
        sql = dialect("WITH " + ", ".join(parts) + select, False, **_values(pieces))
        for name in tables:
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
        return spark.sql(sql, **tables)

    # One row a source and one a shard: written, so that the steps below don't repeat them.
    quota = written(run(_QUOTA, select=" SELECT * FROM quota", sized=sizes), "mix-quota")
    plan = written(run(_DOC, _PLAN, select=" SELECT * FROM plan", sized=sizes, quota=quota), "mix-plan")
    return run(_DOC, _DRAW, sized=sizes, quota=quota, plan=plan)


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """df's rows as the mix takes them: whole copies as they are, then a last partial copy of the drawn blocks' words, one
    space between them. A document that the mix leaves out goes. All columns are carried, whatever their names."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    plan = mix(sized(own), pieces=True).where("taken > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keys = lambda i, s: [F.coalesce(i.cast("string"), F.lit("")).alias("_i"), i.isNull().alias("_in"), F.coalesce(s.cast("string"), F.lit("")).alias("_s"), s.isNull().alias("_sn")]  # noqa: E731  nulls are keys too
    own = own.select("_row", "text", *keys(F.col("doc_id"), F.col("source")), size.alias("_size"))
    own = own.withColumn("_copy", F.row_number().over(Window.partitionBy("_i", "_in", "_s", "_sn", "_size").orderBy("text")).cast("long"))
    plan = plan.select(*keys(F.col("doc_id"), F.col("source")), F.col("size").alias("_size"), F.col("copy").alias("_copy"), "passes", "pieces")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # The words are bound to a lambda variable, else each piece would split the text again.
    pick = lambda w: F.array_join(F.flatten(F.transform(F.array_sort("pieces"), lambda p: F.slice(w, (p.block * BLOCK + 1).cast("int"), p.got.cast("int")))), " ")
    drawn = F.element_at(F.transform(F.array(words), pick), 1)
    copies = F.concat(F.array_repeat("text", F.col("passes")), F.when(F.col("pieces").isNull(), F.array().cast("array<string>")).otherwise(F.array(drawn)))
    out = own.join(plan, ["_i", "_in", "_s", "_sn", "_size", "_copy"]).select("_row", F.explode(copies).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns])


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents")))


ORACLE = dialect(", ".join(["""WITH sized AS (
  SELECT doc_id, source, size, CAST(row_number() OVER (PARTITION BY doc_id, source, size) AS BIGINT) AS copy
  FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents) t
)""", _QUOTA, _DOC, _PLAN, _DRAW]), True, **_values(False))
