"""Main text of web pages by line-block distribution.

Tags form lines, and no more: a block of text is a line, a border of a container an empty line; what the tags or names call
a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment becomes WINDOW empty lines, as does the
border of an article. Names count by whole class tokens, of which the last part is the noun (site-footer, but not
footer-study), or the first where only words of layout follow (ad-slot-2). A paragraph, heading or list item goes by an
unmistakable name only, and an article by none that has other meanings too. Whether a line is text is then decided by lengths
alone. A line's length is that of its text, nothing where most of it is links, except for a paragraph of the article. On a page
without an article element, borders of containers count twice, and a surge takes SHARE of the page's largest window. Lengths are summed over sliding windows of WINDOW lines. A dive point is an empty window; a surge
point a line whose window reaches SURGE characters, or, on a page where none does, the largest window. The lines between
two dive points are kept where a surge point stands between them.

Defined cases: null and empty pages give an empty text; a very long page is read whole; unclosed and misnested tags close with their parents; equal pages
give equal texts; of columns named like a result (text, n_chars) the result's stay; further columns are carried.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, slices, table

WINDOW, SURGE = 3, 80
#: A line with more than this share of its text in links is a menu.
LINKS = 0.5
#: Of the largest window, what a surge takes at least on a page without an article element.
SHARE = 0.2

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("nav footer aside form button menu dialog head fieldset".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKED = frozenset("article aside section main nav footer header form div ul ol table h1 h2 h3 h4 h5 h6 blockquote pre dl hr fieldset".split())
CONTAINERS = frozenset("section div ul ol table blockquote dl".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
TEXTS = PROSE | INLINE | frozenset("li td th dd dt figcaption caption".split())
# Words in class, id and role that name other things than the article; those of WEAK have other meanings too.
STRONG = frozenset(
    "nav navbar navigation menu menubar footer masthead contentinfo complementary sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr"
    " comment comments commentlist disqus breadcrumb breadcrumbs newsletter subscribe subscription signup popup copyright pagination pager".split())
WEAK = frozenset("header banner side aside notice alert respond reply replies discussion share sharing social related recommended modal overlay login search toolbar widget skip toc tags dialog form".split())
# Words of layout.
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons col column container content group holder icons inner inline item items left link links list main news outer panel posts primary region right row secondary"
    " section slot stories text thread title top unit widget wrap wrapper zone".split())
FINAL = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended sidebar aside complementary".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def named_other(names: str) -> tuple[int, bool]:
    """How surely the tokens of class, id and role name another thing than the article (2: surely, 1: by a word with other
    meanings, 0: not), and whether they may not hold it either."""
    strength, final = 0, False
    for token in names.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        word = parts[-1] if parts else ""
        if word not in STRONG and word not in WEAK:
            word = parts[0] if len(parts) > 1 and all(x in LAYOUT or x.isdigit() for x in parts[1:]) else ""
        strength = max(strength, 2 if word in STRONG else int(word in WEAK))
        final = final or word in FINAL
    return strength, final


def lines(page: str) -> list[tuple[str, int]]:
    """(text, length of it in links) of each line, both empty where the page parts its blocks."""
    return parsed(page)[0]


def parsed(page: str, border: int = 1) -> tuple[list[tuple[str, int]], bool]:
    """The lines, and whether the page has an article. border: empty lines for the border of a container."""
    out: list[tuple[str, int]] = []
    part: list[str] = []
    linked = 0
    stack: list[list] = []  # name, skips, is a main element, skips by its names only
    skips = mains = links = prose = 0
    seen_main = in_prose = False

    def flush(gap: int = 0) -> None:
        nonlocal linked, in_prose
        text = _SPACE.sub(" ", "".join(part)).strip()
        if text:
            out.append((text, 0 if in_prose else min(linked, len(text))))
        part.clear()
        linked, in_prose = 0, False
        out.extend([("", 0)] * gap)

    def add(raw: str) -> None:
        nonlocal linked, in_prose
        if raw and not skips:
            text = html.unescape(raw)
            part.append(text)
            in_prose = in_prose or bool(prose and mains and text.strip())
            if links:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal skips, mains, links, prose
        while len(stack) > to:
            name, skip, main, _ = stack.pop()
            skips -= skip
            if main or skip and not skips:
                flush(WINDOW)
            elif name not in INLINE:
                flush(border * (name in CONTAINERS and not skips))
            mains -= main
            links -= name == "a"
            prose -= name in PROSE

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(html.escape(m[1]))
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            if not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
                at = end.end()
            continue
        if name == "br" or (name not in INLINE and name not in VOID) or name == "hr":
            flush()
        closes = CLOSES.get(name, set()) | ({"p"} if name in BLOCKED else set())
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] in BLOCKED or stack[i][0] == "body":
                    break
        if name in VOID:
            continue
        named, main, hidden = "", name in ("article", "main"), False
        for key, *values in _NAMES.findall(m[4]) if m[4] else ():
            value, key = "".join(values), key.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif key in ("class", "id", "role"):
                named += " " + value
                main = main or key == "role" and value.lower() == "main"
        strength, final = named_other(named) if named and name not in ("html", "body") else (0, False)
        other = strength > (1 if main or name in TEXTS else 0)
        by_name = other and name not in SKIPPED and not final
        skip = hidden or other or name in SKIPPED or (name == "header" and not mains)
        if main and not skip and not seen_main and skips:
            # A wrapper that is named like something else, but holds the article.
            for x in stack:
                if x[3]:
                    skips -= x[1]
                    x[1] = x[3] = 0
        main = main and not skip and not skips
        seen_main = seen_main or main
        stack.append([name, int(skip), int(main), int(by_name)])
        if (skip and not skips) or main:
            flush(WINDOW)
        elif name in CONTAINERS and not skips:
            flush(border)
        skips += skip
        mains += main
        links += name == "a"
        prose += name in PROSE
    pop(0)
    flush()
    return out, seen_main


def text_lines(lengths: list[int], share: float = 0.0) -> np.ndarray:
    """Which lines are text, by the lengths alone. share: of the largest window that a surge takes at least."""
    size = np.array(lengths, np.int64)
    if not size.any():
        return np.zeros(len(size), bool)
    window = np.convolve(size, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of a line and those after it
    surge = (window >= min(max(SURGE, share * int(window.max())), int(window.max()))) & (size > 0)
    run = np.cumsum(window == 0)  # dive points part the page into runs
    return (size > 0) & np.isin(run, run[surge])


def extract(page: str) -> str:
    """The main text, one block a line."""
    found, main = parsed(page)
    if not main:
        found, _ = parsed(page, 2)
    kept = text_lines([len(text) if linked <= LINKS * len(text) else 0 for text, linked in found], 0.0 if main else SHARE)
    return "\n".join(found[i][0] for i in np.flatnonzero(kept))


def main_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with the html column replaced by text and n_chars. A column of df of either name goes."""
    names = [c for c in df.columns if c != html_col and c.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, html_col):
                texts = [extract(x) if x else "" for x in b.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return df.mapInArrow(run, extended(df, "text string, n_chars long", names))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
