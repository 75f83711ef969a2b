"""Main text of pages: layouts, malformed markup, odd rows."""

from __future__ import annotations

import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from lakedocs.llm.html_text import Page, densities, extract, main_text, op13_text_density

LONG = "A sentence of some length stands here, and it goes on for a while. " * 4
CASES = {
    "semantic": ("<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article class='post has-comments'><header><h1>Title</h1></header><p>Body a<b>b</b>c&nbsp;d</p><aside>side</aside><form>name<input></form>"
                 f"<section id=comments><article class=comment><p>{LONG}</p></article></section><footer>foot</footer></article></main><footer>&copy;</footer>", "Title Body abc d"),
    "divisions": (f"<div id=cookie-banner>{LONG}</div><div class=page><div class=post-body><h2>Head</h2><p>{LONG}</p><p>Short.</p><ul><li>one<li>two</ul></div><div class='sidebar-left'>{LONG}</div></div>", f"Head {LONG.strip()} Short. one two"),
    "links": (f"<div><p>{LONG}</p><p>{LONG}</p></div><div>" + "<a href=x>more about it</a> " * 40 + "</div>", f"{LONG.strip()} {LONG.strip()}"),
    "sections": (f"<body><h1>Top</h1><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p></section><div><a href=a>a</a><a href=b>b</a></div></body>", f"Top {LONG}{LONG}{LONG}".strip()),
    "short article, long advert": (f"<article><h1>Hi</h1><p>Yes.</p><div class='ad'>{LONG}</div></article><div class=box>{LONG}</div>", "Hi Yes."),
    "roles": (f"<div role=navigation>{LONG}</div><div role=main><p>Text</p></div><div role='complementary'>{LONG}</div>", "Text"),
    "no markup": ("5 &lt; 6 &amp 7 &#233; &unknown;", "5 < 6 & 7 é &unknown;"),
    "open tags": ("<article><p><b>one<br>two<p>three<table><tr><td>4<td>5<tr><td>6</table></b> seven", "one two three 4 5 6 seven"),
    "raw text": ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><title>no</title><p>yes</p><textarea><p>no</textarea>", "yes"),
    "quoted": ("<p title='a > b'>in</p><img alt='x>y'>", "in"),
    "blank": (" \n ", ""), "null": (None, ""), "only menus": ("<nav>a</nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    html, want = CASES[name]
    assert main_text(html) == want


def test_tree_and_densities():
    page = Page("<div><p>abcd</p><p>ef <a href=x>gh</a></p></div>")
    assert page.name == ["body", "div", "p", "p", "a"] and page.parent == [-1, 0, 1, 1, 3] and page.end == [5, 5, 3, 5, 5]
    each, total, _ = densities(page, [False] * 5)
    assert each[2] > each[3] > 0 and total[1] == pytest.approx(each[2] + each[3])


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 1000 + "</p>x", "<div><i>" * 20_000 + "</i></div>" * 20_000 + "x", "<a href='" + "<p>" * 20_000, "<" * 50_000])
def test_hostile_pages_end(html):
    start = time.time()
    main_text(html)
    assert time.time() - start < 20


def test_rows(spark):
    rows = [(1, "u", "<p>a", "old", 7), (None, None, None, "old", 7), (2, "u", "", "old", 7), (1, "u", "<p>a", "old", 7), (3, "u", f"<article><p>{'word ' * 200_000}</article>", "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_nodes int")
    out = extract(pages)
    assert out.columns == [*pages.columns, "n_chars"]
    got = sorted(((r["page_id"] or 0), r["text"][:6], r["n_chars"], r["n_nodes"]) for r in out.collect())
    assert got == [(0, "", 0, 7), (1, "a", 1, 7), (1, "a", 1, 7), (2, "", 0, 7), (3, "word w", 999_999, 7)]
    assert extract(pages.limit(0)).count() == 0


def test_all_pages(spark, sf):
    """The given pages have one article each, of known tags."""
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op13_text_density(spark, sf)
    assert not re.search("Exchange", out._jdf.queryExecution().executedPlan().toString())
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.withColumn("n_chars", F.col("n_chars")).collect()}
    for k, page in html.items():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        want = " ".join(unescape(re.sub("</?(?:p|br|h1)>", " ", inner).replace("<b>", "")).split())
        assert got[k] == (want, len(want))
