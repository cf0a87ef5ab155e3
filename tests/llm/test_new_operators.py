"""Operators 11 to 13 against plain Python: odd rows, hot keys, planted links, and the whole of each method."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.llm import fim, lexical, urls
from skarn.llm.common import by_key, written
from skarn.llm.components import components

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(lexical.TERM)

# ---- 11


@given(st.text(alphabet=" \n\té中😀ab<P>", max_size=60), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_checkpoints(text, every, block):
    units = UNIT.findall(text)
    index = fim.Checkpoints(text.encode(), every, block)
    assert index.n == len(units) and len(index.units) <= 1 + len(units) / every
    for k in range(len(units) + 1):
        prefix = "".join(units[:k])
        assert index.cut(k) == (len(prefix.encode()), len(prefix))


def test_rescans_are_short(monkeypatch):
    """A cut reads from its checkpoint on, and no more than a few steps."""
    text = ("word " * 400_000).encode()
    index = fim.Checkpoints(text)
    read = []
    ends = fim.Checkpoints._ends
    monkeypatch.setattr(fim.Checkpoints, "_ends", lambda self, at, size: read.append((at, size)) or ends(self, at, size))
    assert index.cut(300_000) == (300_000 * 5 - 1, 300_000 * 5 - 1)
    assert sum(size for _, size in read) <= fim.EVERY * 5 + 2 * fim.STEP and min(at for at, _ in read) > 1_490_000


def by_hand(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_of_odd_rows(spark):
    rng = random.Random(3)
    texts = ["", None, " ", "\n\t", "a", " a ", "<P>", "x <S> y", "<M", "S>", "é" * 50, "😀 😀\n", "long " * 300_000, "unbroken" * 100_000] + ["".join(rng.choice("ab <>PSM\n") for _ in range(40)) for _ in range(150)]
    rows = [(i, t, "n", "f") for i, t in enumerate(texts)] + [(None, "null id here", "n", "f"), (7, "again", "n", "f"), (7, "again", "n", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, Form string").repartition(5)
    got = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = got.collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "spm", "psm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text or "")
        assert r.back == (r.text or "")
    assert fim.transform(df.limit(0)).count() == 0


# ---- 12

HTML = {
    "canonical": '<head><link href="{}" rel="canonical"></head>', "loose": "<LINK REL = canonical HREF={}>", "refresh": '<meta http-equiv="Refresh" content="5; URL=\'{}\'">',
    "comment": '<!-- <link rel="canonical" href="{}"> -->', "script": '<script>var x = \'<link rel="canonical" href="{}">\'</script>', "other": '<link rel="stylesheet" href="{}">',
}


def judged(spark, rows, redirects=None, rules=urls.RULES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    red = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects is not None else None
    return {r.page_id: r for r in urls.judge(df, urls.rules_table(spark, rules), red).collect()}


@pytest.mark.parametrize("link", sorted(HTML))
def test_which_links_join(spark, link):
    got = judged(spark, [(1, "http://a.net/x/y?q", HTML[link].format("http://b.com/de/1"))])
    assert got[1].verdict == ("block" if link in ("canonical", "loose", "refresh") else "allow") and got[1].rule is None


def test_links_are_resolved(spark):
    base = "http://a.net/x/y.html?q=1#f"
    links = {"z": "/x/z", "./z": "/x/z", "../z": "/z", "../../../z": "/z", "/z?k=1&amp;l=2": "/z?k=1&l=2", "?k": "/x/y.html?k", "//b.org/c": None, "#top": None, "mailto:x@b.com": None, "z/..": "/x/", "http://A.NET:80/z#g": "/z"}
    rows = [(i, f"http://p{i}.net/x/y.html?q=1#f", HTML["canonical"].format(k)) for i, k in enumerate(links)]
    targets = [(100 + i, f"https://p{i}.net{t}", "") for i, t in enumerate(links.values()) if t]
    got = judged(spark, [(i, u, h.replace("A.NET", f"P{i}.NET")) for i, u, h in rows] + targets)
    for i, (k, t) in enumerate(links.items()):
        if t:
            assert got[i]["class"] == got[100 + i]["class"], (base, k)
    assert got[6].verdict == "allow" and got[7]["class"] != got[8]["class"]


def test_precedence_chains_and_hubs(spark):
    chain = [(i, f"http://c{i}.net/", HTML["refresh"].format(f"http://c{i + 1}.net/")) for i in range(40)] + [(40, "http://c40.net/", HTML["canonical"].format("http://x.com/de/"))]
    hub = [(100 + i, f"http://h.net/{i}", HTML["canonical"].format("http://h.net/")) for i in range(300)] + [(500, "http://www.example.org/es/1", HTML["canonical"].format("http://h.net/"))]
    allowed = [(600, "http://m.net/", HTML["canonical"].format("http://s.org/")), (601, "http://n.net/", HTML["canonical"].format("http://m.net/")), (602, "http://x.com/de/2", HTML["canonical"].format("http://m.net/"))]
    odd = [(700, None, "x"), (701, "no host", None), (702, "http://", ""), (703, "http://lone.net", None), (704, "http://lone.net/", HTML["canonical"].format("http://lone.net/")), (705, "HTTP://Example.ORG/es/", None), (706, "http://example.org/es", None), (707, "http://notexample.org/es/", None), (708, "http://x.example.org/en/12?a#b", None), (709, "http://org/", None)]
    got = judged(spark, [*chain, *hub, *allowed, *odd, *odd])
    assert {got[i].verdict for i in range(41)} == {"block"} and len({got[i]["class"] for i in range(41)}) == 1
    assert {got[i].verdict for i in range(100, 400)} == {"block"} and got[500].rule == "example.org/es/"
    assert [got[i].verdict for i in (600, 601, 602)] == ["allow", "allow", "block"]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (700, 701, 702, 703)] == [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("lone.net", "", None, "allow")]
    assert got[703]["class"] == got[704]["class"] and got[700]["class"] is None
    assert [got[i].rule for i in (705, 706, 707, 708, 709)] == ["example.org/es/", "org/", "org/", "example.org/en/1", "org/"]


def test_redirect_log_many_rules_and_further_columns(spark, monkeypatch):
    monkeypatch.setattr(urls, "FEW_RULES", 2)  # rules by shuffle
    rng = random.Random(2)
    hosts = [f"{a}.{b}" for a in ("a", "b", "c.a") for b in ("net", "com", "x.org")]
    rules = [(rng.choice(["allow", "block"]), rng.choice([*hosts, "net", "com", "x.org", "org"]), rng.choice(["/", "/p", "/p/q", "/p/q/r", ""])) for _ in range(30)]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q', '/pq/r', '/p/q/rs'])}{rng.choice(['', '?k', '#f'])}", None) for i in range(200)]
    redirects = [(rng.choice(pages)[1], rng.choice(pages)[1]) for _ in range(25)]
    got = judged(spark, pages, redirects, rules)

    def parts(url):
        rest = url.partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        return host, re.split("[?#]", rest[len(host) :])[0], (host, re.split("#", rest[len(host) :])[0] if rest[len(host) :].startswith("/") else "/" + rest[len(host) :].split("#")[0])

    def rule_of(host, path):
        fit = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fit)[3], max(fit)[4]) if fit else (None, None)

    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in redirects:
        parent[find(parts(a)[2])] = find(parts(b)[2])
    said = collections.defaultdict(set)
    for _, u, _ in pages:
        host, path, node = parts(u)
        said[find(node)].add(rule_of(host, path)[1])
    for i, u, _ in pages:
        host, path, node = parts(u)
        rule, verdict = rule_of(host, path)
        votes = said[find(node)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("allow" if "allow" in votes else "block" if "block" in votes else "allow"))

    df = spark.createDataFrame([(1, "http://a.net/", "", "kept", "gone", "gone")], "page_id long, url string, html string, node string, class string, Verdict string")
    out = urls.judge(df, urls.rules_table(spark, rules))
    assert out.columns == ["page_id", "url", "node", "host", "path", "rule", "verdict", "class"] and out.first().node == "kept"
    assert urls.judge(df.limit(0), urls.rules_table(spark, rules)).count() == 0


def test_hot_keys_are_joined_whole(spark):
    left = written(spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), "id"), "t")
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = by_key(left, right, "k", 16, how).collect()
        want = [(r.k, r.id) for r in left.collect() if how == "left" or r.k < 2500]
        assert sorted((r.k, r.id) for r in got) == sorted(want) and all(r.v == (2 * r.k if r.k < 2500 else None) for r in got)
    star = spark.range(1, 500).select(F.lit("0hub").alias("a"), F.col("id").cast("string").alias("b"))
    assert {r.label for r in components(star, hot=4).collect()} == {"0hub"} and components(star.limit(0), hot=4).count() == 0


# ---- 13


def ranked(docs, items, k=10):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)})))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)})))
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in terms.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "中文", "😀", "İx"]
    topics = [rng.sample(words, 25) for _ in range(12)]
    docs = [(i, " ".join(rng.choices(rng.choice(topics), k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)] + [(5, docs[5][1]), (5, "other text"), (None, docs[3][1]), (9001, None), (9002, " .,; "), (9003, ""), (9004, "x" * 100_000 + " w1 " + "w2 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(30)]
    items += [(0, "w1 w1, W2"), (50, docs[3][1]), (51, ""), (52, None), (53, "nowhere to be found"), (None, "w7 w8"), (54, "w1 " * 50)]
    return docs, items


@pytest.mark.parametrize("cluster", [64, 4])
def test_search_against_brute_force(spark, monkeypatch, cluster):
    monkeypatch.setattr(lexical, "CLUSTER", cluster)
    monkeypatch.setattr(lexical, "PIECE_DOCS", 100)
    monkeypatch.setattr(lexical, "BLOCK", 9)
    docs, items = corpus(cluster, 400)
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, score string").repartition(5)
    stored = lexical.index(df)
    assert stored.agg(F.sum(F.size("doc_ids"))).first()[0] == sum(bool(TERM.search(t or "")) for _, t in docs)
    got = lexical.search(stored, spark.createDataFrame(items, "item_id long, text string"))
    assert collections.Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == ranked(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    search = lambda d, i: [tuple(r) for r in lexical.search(lexical.index(d), i).collect()]
    assert search(docs, items) == [t for t in ranked([(1, "a b"), (2, None)], [(1, "a")])]
    assert search(docs.limit(0), items) == [] and search(docs, items.limit(0)) == [] and search(docs.where("doc_id = 2"), items) == []


def test_bisection_brings_like_documents_together():
    rng = random.Random(1)
    groups = [[f"g{g}t{i}" for i in range(30)] for g in range(8)]
    own = [g for g in range(8) for _ in range(32)]
    rng.shuffle(own)
    ids = {t: i for i, t in enumerate(itertools.chain(*groups))}
    docs = [[ids[t] for t in rng.sample(groups[g], 12)] for g in own]
    indptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    order = lexical.ordered(indptr, np.concatenate([np.array(d) for d in docs]), 32)
    assert sorted(order.tolist()) == list(range(256))
    pure = [collections.Counter(own[d] for d in order[i : i + 32]).most_common(1)[0][1] for i in range(0, 256, 32)]
    assert sum(pure) >= 0.9 * 256


def test_bounds_stop_the_search(spark, monkeypatch):
    """Clusters below the threshold are left out: most of them, where documents have topics."""
    monkeypatch.setattr(lexical, "CLUSTER", 16)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices([f"t{i % 20}w{j}" for j in range(40)], k=60))) for i in range(800)]
    stored = lexical.index(spark.createDataFrame(docs, "doc_id long, text string"))
    column = {f"t3w{j}".encode(): j for j in range(5)}
    weights = np.full((1, 5), 1000.0)
    rows = [lexical.Cluster(r.asDict(), column) for r in stored.collect()]
    bounds = np.array([c.bounds(weights)[0] for c in rows])
    best = sorted(np.concatenate([c.scores(weights)[0] for c in rows]))[-10]
    assert (bounds >= best).mean() < 0.25
    for c, bound in zip(rows, bounds, strict=True):
        assert c.scores(weights).max(initial=0) <= bound


def test_terms_of_long_texts(monkeypatch):
    text = "Ab-é中 x1" + " tail" * 1000 + "y" * 500
    want = collections.Counter(t.encode() for t in TERM.findall(text.replace("A", "a")))
    assert lexical.term_counts(text) == want
    for part in (1, 7, 100):
        monkeypatch.setattr(lexical, "PART", part)
        assert lexical.term_counts(text) == want
