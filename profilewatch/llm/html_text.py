"""HTML extraction by line-block distribution.

A page is stripped of markup and cut into lines at block elements. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are never kept, nor are lines that
consist of links; they are taken out first. The lengths of the others are summed over a sliding
window of ``WINDOW`` lines; where the sum rises above a threshold the text surges, and where it
falls back for good the text dives. Every line from the first surge to the last dive is kept, a list of
short lines between them too. A page whose text never surges is kept whole.

A page that names its article (``article``, ``main``, or a role or class that says so)
has its distribution taken over that part alone. The name weighs, but decides nothing by itself:
there the text surges and dives at ``NAMED_SURGE``, so short paragraphs at its edges stay while counters and
icons behind them go, and a line consists of links when ``NAMED_LINKED`` tenths of it do. A wrapper with the only article of the page,
or a layout or form with most of its text, is not left out whatever its name.

Each page is worked on by itself in a task; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at which the text surges, on a page that does not name its article.
SURGE = 90
#: The same inside a named article: a few words in a window are text.
NAMED_SURGE = SURGE // 6
#: Tenths of a line that may be links, on a page that does not name its article and inside a named one.
LINKED, NAMED_LINKED = 5, 9

#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea datalist".split())
#: Of these, the ones whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of a class, id or role that say the same.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments reply replies respond disqus feedback "
    "widget copyright pagination pager toolbar search complementary contentinfo skip".split()
)
#: Of these, the ones that say so however much text they hold; the others also name layouts.
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr notice newsletter "
    "related recommended comment comments reply replies respond disqus feedback copyright".split()
)
#: First and last words of a name that speaks of an aside elsewhere (with-sidebar, nav-open).
BEFORE = frozenset("with without has have no not show hide".split())
AFTER = frozenset("open opened closed collapsed expanded enabled disabled".split())
#: These only say so outside an article.
OUTER_WORDS = frozenset("header masthead topbar".split())
ARTICLE = frozenset(["article", "main"])
ARTICLE_WORDS = frozenset(["articlebody", "article", "main", "post-content", "entry-content", "article-body", "article-content", "maincontent"])

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_OPEN_END = re.compile(r"<!--|<!\[CDATA\[")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CUT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    text: str
    linked: int
    aside: bool
    inside: bool
    #: Where the tag of the element that leaves the line out begins.
    start: int = -1


def _named(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether the class, id or role of an element names an aside, an article, and an aside for sure."""
    aside = article = sure = False
    for groups in _NAMES.findall(attributes):
        value = "".join(groups)
        for word in value.split():
            row = [p for p in _CUT.split(_CAMEL.sub("-", word).lower()) if p]
            parts = set(row)
            if len(row) == 1 or row and row[0] not in BEFORE and row[-1] not in AFTER:
                aside |= bool(parts & ASIDE_WORDS) or (not inside and bool(parts & OUTER_WORDS))
                sure |= bool(parts & SURE_WORDS)
            article |= word.lower() in ARTICLE_WORDS
    return aside, article and not aside, sure


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order, with what is known of each.

    An element that would be left out stays when it holds the only article of the page, or when
    it is a layout or form outside of articles that holds most of the page's text.
    """
    free: set[int] = set()
    while True:
        lines, layouts, holders = _parsed(page, free)
        size: dict[int, int] = {}
        for line in lines:
            size[line.start] = size.get(line.start, 0) + max(0, len(line.text) - line.linked)
        total = sum(size.values())
        more = {k for k in layouts if 2 * size.get(k, 0) > total and (size[k] >= SURGE or size[k] == total)}
        if not any(line.inside and not line.aside for line in lines):
            more |= holders
        if not more:
            return lines
        free |= more


def _parsed(page: str, free: set[int]) -> tuple[list[Line], set[int], set[int]]:
    """The lines, and the elements left out outside of articles that may be layouts, or that hold an article.

    Elements are named by where their tag begins; those in ``free`` are not left out.
    """
    lines: list[Line] = []
    layouts: set[int] = set()
    holders: set[int] = set()
    start = -1
    parts: list[str] = []
    linked = 0
    off = ""  # element that is being left out, and how deep it is nested in itself
    off_depth = 0
    inside_tags: list[list] = []  # open articles as [tag, depth]
    link = False
    unseen, unseen_depth = "", 0

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, linked, bool(off), bool(inside_tags), start if off else -1))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if link:
                linked += len(" ".join(html.unescape(text).split()))

    at, n = 0, len(page)
    closes = page.rfind(">")  # behind it no tag ends, so none is looked for
    while at < n:
        m = _TOKEN.search(page, at) if at <= closes else None
        if m is None:
            tail = page[at:]
            open_end = _OPEN_END.search(tail)
            tail = tail[: open_end.start()] if open_end else tail
            # a tag that the end of the page cuts off: all of it if nothing behind it could end it
            cut = re.search(r"<[a-zA-Z/!?][^<]*$" if at <= closes else r"<[a-zA-Z/!?]", tail)
            add(tail[: cut.start()] if cut else tail)
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1]), m[3]
        if unseen:
            if tag == unseen:
                unseen_depth += -1 if closing else 1
                if unseen_depth == 0:
                    unseen = ""
            elif unseen == "head" and tag == "body":
                unseen = ""
            continue
        if tag in UNSEEN and not closing:
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif not attributes.rstrip().endswith("/"):
                unseen, unseen_depth = tag, 1
            if tag not in INLINE:
                close_line()
            continue
        if tag == "a":
            link = not closing
        if tag not in INLINE:
            close_line()
        aside, article, sure = _named(attributes, bool(inside_tags)) if not closing and "=" in attributes else (False, False, False)
        if off:
            if tag == off and tag not in VOID:
                off_depth += -1 if closing else 1
                if off_depth == 0:
                    close_line()
                    off = ""
            elif not closing and tag in ARTICLE and off in ("nav", "header", "menu", "form"):
                off = ""  # an element that was never closed does not take the article with it
            elif not closing and not inside_tags and not aside and (tag in ARTICLE or article):
                holders.add(start)
            if off or closing:
                continue
        if closing:
            for held in inside_tags[-1:]:
                if tag == held[0]:
                    held[1] -= 1
                    if held[1] == 0:
                        close_line()
                        inside_tags.pop()
            continue
        if tag in VOID:
            continue
        left_out = tag in ASIDE or aside and tag not in ("body", "html", "article", "main") or tag == "header" and not inside_tags
        if left_out and m.start() not in free:
            close_line()
            off, off_depth, start = tag, 1, m.start()
            if not inside_tags and not sure and (tag in ("form", "fieldset") or tag not in ASIDE and tag != "header"):
                layouts.add(start)
            continue
        if tag in ARTICLE or article:
            close_line()
            inside_tags.append([tag, 1])
        elif inside_tags and tag == inside_tags[-1][0]:
            inside_tags[-1][1] += 1
    close_line()
    return lines, layouts, holders


def kept_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE, named_surge: int = NAMED_SURGE) -> list[str]:
    """The lines from the first surge of their distribution to its last dive, of a named article too.

    Behind the last surge the text dives at the first whole window that is not above the
    threshold: lines that fill no window of their own (a short last paragraph) still belong to it.
    """
    named = any(line.inside and not line.aside for line in lines)
    # lines that are no text of the page go first, so that a box of them opens no gap
    own = [line for line in lines if not line.aside and (line.inside or not named)]
    most = NAMED_LINKED if named else LINKED
    own = [line for line in own if min(line.linked, len(line.text)) * 10 <= len(line.text) * most]
    if not own:
        return []
    threshold = named_surge if named else surge
    weight = np.array([len(line.text) for line in own])
    sums = np.convolve(weight, np.ones(window, dtype=int))[window - 1 :]  # from each line on
    whole = len(own) - window + 1  # windows that end before the page does
    risen = np.flatnonzero(sums > threshold)
    if not len(risen):
        return [line.text for line in own]  # a page of little text
    surged, dives = int(risen[0]), int(risen[-1]) + 1
    return [line.text for line in own[surged : dives if dives < whole else len(own)]]


def main_text(page: str | None) -> str:
    return " ".join(kept_lines(lines_of(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Character references are decoded once, white space inside a block is one space,
    blocks are joined in page order by one space. A null or empty page, or one without
    text, gives an empty text. Repeated rows are extracted each; null ids and urls are
    passed through. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
