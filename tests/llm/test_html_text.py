import html
import re

import pytest
from pyspark.sql import functions as F

from profilewatch.llm.html_text import extract, main_text
from tests.llm.corpus import documents

LONG = "a sentence of some length that goes on for quite a while, as paragraphs do. " * 3
ARTICLE = "<h1>Head</h1><p>First &amp; second\n line.</p><p>x</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>&copy; me</footer>", "Head First & second line. x"),
        (f"<article>{ARTICLE}<aside>more</aside><div class='ad box'>buy</div><p>end</p></article>", "Head First & second line. x end"),
        (f"<article>{ARTICLE}<section id=comments><p>{LONG}</p></section></article>", "Head First & second line. x"),
        ("<main><p>one<br>two<b>three</b></p><form>name <input></form></main><p>out</p>", "one twothree"),
        ("<article><p>&lt;b&gt; &amp;amp; &#233;&nbsp;&#x41;</p></article>", "<b> &amp; é A"),
        ("<article><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></article>", "yes"),
        ("<article><p>cut off <b>here</article><footer>gone</footer></bo", "cut off here"),
        ("<div class=cookie-notice>We use cookies, a lot of them, on all of our many pages.</div><article>hi</article>", "hi"),
        ("<header><p>Site</p></header><article><header><h1>Title</h1></header><p>b</p><footer>by me</footer></article>", "Title b"),
        (f"<div><a href=1>One</a><a href=2>Two</a></div><div><p>{LONG}</p><p>short</p><p>{LONG}</p></div>", f"{LONG}short {LONG}".strip()),
        ("just text", "just text"),
        ("", ""),
        (None, ""),
        ("<p></p><script>only()", ""),
    ],
)
def test_pages(page, want):
    assert main_text(page) == " ".join(want.split())


def test_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in documents(sf_dir, "pages")}
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]["html"]
        inside = page[page.index("<article>") : page.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1|article)>", " ", inside))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_nulls_copies_clashing_columns_and_an_empty_table(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "u", None), (3, "v", "<article>" + "<p>w</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in extract(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (3, 39_999)]
    assert extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "has-related", "nav-open", "hasSidebar", "sidebar-page", "menu"])
@pytest.mark.parametrize("tag", ["div", "section", "form"])
def test_a_layout_keeps_its_article(name, tag):
    page = f"<p>Top</p><{tag} class='{name}'><div class=sidebar>{LONG}</div><article>{ARTICLE}</article></{tag}><footer>end</footer>"
    assert main_text(page) == "Head First & second line. x"
    assert main_text(page.replace("article>", "main>")) == "Head First & second line. x"


@pytest.mark.parametrize("opening", ["form", "form id=aspnetForm", "div class=sidebar-layout"])
def test_a_wrapper_of_most_of_the_text_stays(opening):
    inner = f"<nav><a href=1>One</a></nav><div>{LONG}</div><div class=cookie-notice>We use cookies.</div><div>{LONG}</div>"
    assert main_text(f"<body><{opening}>{inner}</{opening.split()[0]}><footer>(c)</footer></body>") == f"{LONG}{LONG}".strip()


def test_asides_stay_out():
    teaser = f"<article>{LONG}</article>"
    assert main_text(f"<article>{ARTICLE}</article><div class=related>{teaser}{teaser}</div>") == "Head First & second line. x"
    assert main_text(f"<div>{LONG}</div><div id=comments>{LONG * 4}</div><form>Name <input></form>") == LONG.strip()


@pytest.mark.parametrize("box", ["<div class=ad>buy</div>", "<p><a href=1>more of this</a></p>", "<aside>see also</aside>"])
@pytest.mark.parametrize("closing", [LONG * 6, "The end."])
def test_a_box_does_not_split_an_article(box, closing):
    page = f"<div>{f'<p>{LONG}</p>' * 40}{box * 6}<p>{closing}</p></div>"
    assert main_text(page) == f"{LONG * 40}{closing}".strip()


FEET = "".join(f"<div>{x}</div>" for x in ("Contact us", "Imprint", "Terms of use", "All rights reserved"))


def test_text_dives_where_its_lines_get_short_for_good():
    body = f"<h1>Head</h1>{f'<p>{LONG}</p>' * 8}"
    want = f"Head {LONG * 8}".strip()
    assert main_text(f"<div>{body}</div>{FEET}") == want
    assert main_text(f"<div>{body}</div>{FEET * 5}") == want
    # a list between two surges, and a short end that fills no window, stay
    items = "".join(f"<li>item {i}</li>" for i in range(9))
    listed = " ".join(f"item {i}" for i in range(9))
    assert main_text(f"<div>{body}<ul>{items}</ul><p>{LONG}</p><p>The end.</p><p>Me</p></div>") == f"{want} {listed} {LONG}The end. Me"
    # a named article ends where it says, a page that never surges stays whole
    assert main_text(f"<article>{body}<ul>{items}</ul></article>{FEET}") == f"{want} {listed}"
    assert main_text("<p>a</p><p>b</p><p>c</p><p>d</p>") == "a b c d"


def test_the_distribution_decides_inside_a_named_article():
    body = f"<h1>Head</h1>{f'<p>{LONG}</p>' * 8}"
    want = f"Head {LONG * 8}".strip()
    marks = "".join(f"<div>{x}</div>" for x in ("A-", "A+", "12", "3", "|"))
    for tag in ("article", "main", "div class=post-content"):
        close = f"</{tag.split()[0]}>"
        # rows of counters and icons fill no window, before the text and behind it
        assert main_text(f"<{tag}>{marks}{body}{marks}{close}{FEET}") == f"| {want}"
        assert main_text(f"<{tag}>{body}{marks}<p>{LONG}</p><p>Me</p>{close}") == f"{want} A- A+ 12 3 | {LONG}Me"
        # lines that consist of links go wherever they stand, links in a sentence do not
        links = "<ul><li><a href=1>More of this &amp; that</a></li><li><a href=2>One</a> | <a href=3>Something else</a></li></ul>"
        cite = "<p>See <a href=4>the &#228;&#228;&#228;&#228; report</a>.</p>"
        assert main_text(f"<{tag}>{body}{links}{cite}<p>{LONG}</p>{links}{close}") == f"{want} One | Something else See the ääää report. {LONG}One | Something else"


def test_broken_pages_take_time_in_proportion():
    import time

    start = time.perf_counter()
    assert main_text("<p>before</p>" + "<div " * 200_000) == "before"
    assert main_text("<p>before</p>text <!-- never closed " + "<b " * 200_000) == "before text"
    assert main_text("<div " * 200_000 + "><p>after</p>") == "after"
    assert time.perf_counter() - start < 5
