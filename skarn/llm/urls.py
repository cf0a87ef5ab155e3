"""URL filters with redirect equivalence. DataFrame functions only.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path starts with the rule's, and the
longest fitting rule decides. What no rule fits is decided by its aliases: pages are joined to the targets of their redirects
(meta refresh, and edges given from a crawl's log) and canonical links, and the classes of urls that reach each other are found
as distributed connected components. A url without a rule of its own is allowed where any alias is explicitly allowed, else
blocked where any is blocked, else allowed. Targets that are no pages themselves count as aliases with their rules.

Urls that differ in scheme, fragment, default port or the case of their host are one resource, and so one node.

Rules meet urls by equal keys: a url's host suffixes find the rules' hosts, and for each of the path lengths that a host's rules
have, the url's path prefix finds the rule. Equal (host, path) pairs are judged once. A node or class that holds many rows
(a home page that a third of all pages redirect to) is joined by a broadcast of at most HOT rows, as no more keys than that
can hold 1/HOT of the rows.

Defined cases: a null url, or one without "://" and so without host, has empty host and path, no rule and no aliases: allow.
Repeated rows are judged alike; equal rules count once, and of equal rules with both verdicts allow wins. Of two rules of one
length the one with the longer host wins. Links in comments and scripts, and of schemes without a host, are none. A null html
has no links. Empty tables give empty results; without rules all is allowed. Further columns are carried, except those named
like a result (host, path, rule, verdict, class).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, table, written
from .components import components

#: Keys that hold more than 1/HOT of the rows are joined by broadcast.
HOT = 1024
#: Rules up to which they are broadcast.
FEW_RULES = 100_000

#: The rules of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# How HTML names the links that make two urls one resource.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
LINK, CANONICAL, HREF = r"(?is)<link\b[^>]*>", r"""(?is)\srel\s*=\s*["']?\s*canonical\b""", r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
META, REFRESH, CONTENT = r"(?is)<meta\b[^>]*>", r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b""", r"""(?is)\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A digest of the resource that a url names: host without default port, path and query. Null without a host."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?\z", "")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.md5(F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))).cast("binary")))


def links_of(html: Column) -> Column:
    """The hrefs of canonical links and the targets of refreshes, as they stand."""
    seen = F.regexp_replace(html, HIDDEN, " ")
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, i) for i in (1, 2, 3)])
    canonical = F.transform(F.filter(F.regexp_extract_all(seen, F.lit(LINK), F.lit(0)), lambda t: t.rlike(CANONICAL)), href)
    refresh = F.transform(F.filter(F.regexp_extract_all(seen, F.lit(META), F.lit(0)), lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(t, CONTENT, 1))
    found = F.transform(F.concat(canonical, refresh), lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&")))
    none = F.array().cast("array<string>")
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(found, lambda t: t != "")).otherwise(none)


def resolved(link: Column, base: Column) -> Column:
    """The absolute url of a link on a page; null for schemes without a host and for places inside the page."""
    root = F.concat(F.lit("http://"), host_of(base))
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    own, tail = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)\z", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), own))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.slice(F.split(whole, "/"), 2, F.length(whole) + 1), F.array(F.lit("")), step)
    closed = F.when(whole.rlike(r"/\.\.?\z"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.rlike(r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, F.array_join(closed, "/"), tail))
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict, host, path of a short list of rules."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True)]) for r in rules])).alias("r")).select("r.*")


def judged(df: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of each distinct (host, path) of df that a rule fits."""
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict")
    lengths = rules.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_lengths"))
    if not few:
        rules, lengths = written(rules, "url-rules"), written(lengths, "url-lengths")
    urls = df.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path", F.explode(suffixes).alias("_h"))
    each = each.join(F.broadcast(lengths), "_h") if few else by_key(written(each, "url-hosts"), lengths, "_h", HOT)
    prefixes = each.select("host", "path", "_h", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n")).select("host", "path", "_h", F.expr("substring(path, 1, _n)").alias("_p"))
    found = prefixes.join(F.broadcast(rules), ["_h", "_p"]) if few else prefixes.join(rules, ["_h", "_p"])
    longest = F.struct(F.length("_h") + F.length("_p"), F.length("_h"))
    return found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), "verdict"), longest).alias("r")).select("host", "path", "r.rule", "r.verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """pages with host, path, rule (null if none fits), verdict, and class (the least node of its aliases, null without a
    host). redirects: (from_url, to_url) of a crawl's log. The html is read, not carried."""
    result = ("host", "path", "rule", "verdict", "class")
    names = [c for c in pages.columns if c.lower() not in result and c != html_col]
    url = F.col(f"`{url_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    links = links_of(F.col(f"`{html_col}`")) if html_col else F.array().cast("array<string>")
    targets = F.filter(F.transform(links, lambda t: resolved(t, url)), lambda t: t.isNotNull())
    seen = written(pages.select(row, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), F.when(host_of(url) != "", targets).alias("targets")), "url-pages")

    ends = seen.where(F.size("targets") > 0).select(F.col("node").alias("a"), F.explode("targets").alias("to"))
    if redirects is not None:
        ends = ends.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), F.col("to_url").alias("to")))
        more = redirects.select(F.explode(F.array("from_url", "to_url")).alias("u"))
    else:
        more = ends.select(F.col("to").alias("u"))
    edges = written(ends.select("a", node_of(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "url-edges")
    others = more.unionByName(ends.select(F.col("to").alias("u"))).select(host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), node_of(F.col("u")).alias("node")).where("node is not null").distinct()
    places = seen.where("node is not null").select("host", "path", "node").unionByName(others).distinct()
    ruled = written(judged(places, rules), "url-judged")

    said = places.join(ruled, ["host", "path"], "left").groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    labels = components(edges, hot=HOT)
    nodes = written(said.join(labels, "node", "left").select("node", "allow", "block", F.coalesce("label", "node").alias("class")), "url-nodes")
    classes = nodes.groupBy("class").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    of_node = by_key(nodes.select("node", "class"), written(classes, "url-classes"), "class", HOT)
    alias = F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow")
    of_node = written(of_node.select("node", "class", alias.alias("alias")), "url-aliases")

    of_place = ruled.select(F.concat("host", "path").alias("place"), "rule", "verdict")  # a path is empty or starts with what ends a host
    known = written(by_key(seen.drop("targets").withColumn("place", F.concat("host", "path")), of_place, "place", HOT, "left"), "url-ruled")
    known = by_key(known, of_node, "node", HOT, "left")
    return known.select("_row.*", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"), "class")


def _duck(url: str) -> dict[str, str]:
    """host, path and node of a url in DuckDB."""
    host = f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    bare = f"regexp_replace({host}, ':(?:80|443)?\\z', '')"
    node = f"CASE WHEN {bare} <> '' THEN md5(concat({bare}, CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE concat('/', {rest}) END)) END"
    return {"host": host, "path": f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')", "node": node}


_QUOTED = {k: v.replace("'", "''") for k, v in {"HIDDEN": HIDDEN, "LINK": LINK, "CANONICAL": CANONICAL, "HREF": HREF, "META": META, "REFRESH": REFRESH, "CONTENT": CONTENT}.items()}
_PAGE, _TO = _duck("url"), _duck("u")
ORACLE = f"""WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_PAGE["host"]} AS host, {_PAGE["path"]} AS path, {_PAGE["node"]} AS node FROM pages
), s AS (
  SELECT *, regexp_replace(html, '{_QUOTED["HIDDEN"]}', ' ', 'g') AS seen FROM p WHERE host <> '' AND regexp_matches(html, '(?i)canonical|refresh')
), l AS (
  SELECT host, path, node, concat(regexp_extract(t, '{_QUOTED["HREF"]}', 1), regexp_extract(t, '{_QUOTED["HREF"]}', 2), regexp_extract(t, '{_QUOTED["HREF"]}', 3)) AS link
  FROM (SELECT *, unnest(regexp_extract_all(seen, '{_QUOTED["LINK"]}')) AS t FROM s) x WHERE regexp_matches(t, '{_QUOTED["CANONICAL"]}')
  UNION ALL SELECT host, path, node, regexp_extract(t, '{_QUOTED["CONTENT"]}', 1)
  FROM (SELECT *, unnest(regexp_extract_all(seen, '{_QUOTED["META"]}')) AS t FROM s) x WHERE regexp_matches(t, '{_QUOTED["REFRESH"]}')
), k AS (
  SELECT host, CASE WHEN path = '' THEN '/' ELSE path END AS path, node, replace(trim(link), '&amp;', '&') AS link FROM l
), w AS (
  SELECT *, CASE WHEN starts_with(link, '/') THEN regexp_extract(link, '^[^?#]*') ELSE concat(regexp_extract(path, '(?s)^(.*/)', 1), regexp_extract(link, '(?s)^[^?#]*')) END AS whole FROM k WHERE link <> ''
), r AS (
  SELECT node, CASE WHEN regexp_matches(link, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN concat('http:', link)
    WHEN regexp_matches(link, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL WHEN starts_with(link, '?') THEN concat('http://', host, path, link)
    ELSE concat('http://', host, array_to_string(list_concat(
      list_reduce(list_concat([['']], list_transform(string_split(whole, '/')[2:], lambda x: [x])), lambda a, x: CASE x[1] WHEN '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN '.' THEN a ELSE list_concat(a, x) END),
      CASE WHEN regexp_matches(whole, '/\\.\\.?\\z') THEN [''] ELSE [] END), '/'), regexp_extract(link, '(?s)^[^?#]*(.*)\\z', 1)) END AS u FROM w
), t AS (
  SELECT node AS a, {_TO["host"]} AS host, {_TO["path"]} AS path, {_TO["node"]} AS node FROM r WHERE u IS NOT NULL
), e AS (
  SELECT a AS x, node AS y FROM t WHERE node IS NOT NULL UNION SELECT node, a FROM t WHERE node IS NOT NULL
), places AS (
  SELECT host, path, node FROM p WHERE node IS NOT NULL UNION SELECT host, path, node FROM t WHERE node IS NOT NULL
), rules(verdict, rh, rp) AS (VALUES {", ".join(str(x) for x in RULES)}
), judged AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM (SELECT host, path FROM places UNION SELECT host, path FROM p) y) x JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
), reach(node, other) AS (
  SELECT node, node FROM places UNION SELECT reach.node, e.y FROM reach JOIN e ON reach.other = e.x
), said AS (
  SELECT reach.node, bool_or(j.verdict = 'allow') AS allowed, bool_or(j.verdict = 'block') AS blocked
  FROM reach JOIN places ON places.node = reach.other LEFT JOIN judged j ON j.host = places.host AND j.path = places.path GROUP BY reach.node
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN judged j ON j.host = p.host AND j.path = p.path LEFT JOIN said ON said.node = p.node"""


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")
