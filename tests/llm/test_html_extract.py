import time

import pytest

from tamis.llm import html_extract
from tamis.llm.html_extract import extract_pages, extract_text

LONG = "A long paragraph with quite a lot of words, so that it clearly is the main text of this page and not a menu."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp;c &lt;d&gt;</p>", "a & b c <d>"),
        (f"<nav><a>Menu</a></nav><article><h1>T</h1><p><b>{LONG}<br>more<p>x</p></article><footer>f</footer>", f"T {LONG} more x"),
        (f"<header><h1>Site</h1></header><div class='layout has-sidebar'><div id=content><h1>T</h1><p>{LONG}</p><p>s</p><p>{LONG}</p><form>f</form><div class=comments><p>{LONG}</p></div></div><div class=sidebar><ul><li>a<li>b</ul></div></div>", f"T {LONG} s {LONG}"),
        (f"<article><p>{LONG}</p><p class='notice'>n<p>{LONG}</p><div class=ad>{LONG}</div><section id=comments><article><p>{LONG}</p></article></section></article>", f"{LONG} {LONG}"),
        (f"<script>var t='</p>';</script><style>p{{}}</style><article><p>foo<b>bar</b>\n  baz <i>q</i></p>{LONG}<!-- c --></article", f"foobar baz q {LONG}"),
        (f"<article><table><tr><td>a<td>b</table><p>{LONG}</p><ul><li>one<li>two</ul></article>", f"a b {LONG} one two"),
    ],
)
def test_main_text(html, text):
    assert extract_text(html) == text


def test_pages_keep_their_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (2, None, None, "old"), (None, "v", f"<p>{LONG * 500}</p>", "old")]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert found.columns == ["page_id", "url", "text"]
    assert sorted((str(r.page_id), len(r.text)) for r in found.collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", len(LONG) * 500)]
    assert extract_pages(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div><h1>T</h1><p>short</p><p>{LONG * 9}</p></div>", f"T short {LONG * 9}"),
        (f"<p>short</p><p>{LONG * 9}</p>", f"short {LONG * 9}"),
        (f"<body><nav>m</nav><div><h1>T</h1><div id=content><p>{LONG * 9}</p></div></div></body>", f"T {LONG * 9}"),
        (f"<body><div><div><p>{LONG * 9}</p><p>b</p></div><div><p>{LONG}</p></div></div><footer>f</footer></body>", f"{LONG * 9} b {LONG}"),
        (f"<div><ul><li>a<li>{LONG * 9}</ul><blockquote>{LONG}</blockquote></div>", f"a {LONG * 9} {LONG}"),
    ],
)
def test_pages_without_an_article_keep_all_content(html, text):
    assert extract_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<form id=aspnetForm><div><h1>T</h1><p>{LONG}</p></div></form>", f"T {LONG}"),
        (f"<article><p class=ad-hoc>{LONG}</p><section class='related-work'>w</section><ul id=share-prices><li>x</ul><div class=ad-slot>y</div><div class='related-posts box'>z</div></article>", f"{LONG} w x"),
    ],
)
def test_hints_are_no_more_than_that(html, text):
    assert extract_text(html) == text


PLAIN_MENU = "<div><ul>" + "".join(f"<li><a>Item {k}</a></li>" for k in range(12)) + "</ul></div>"
STORY = ["A headline of the story", "A short first line.", *(f"{LONG} {k}" for k in range(6)), "A short last line."]
PLAIN_PAGE = f"<body>{PLAIN_MENU}<div><h1>{STORY[0]}</h1>{''.join(f'<p>{x}</p>' for x in STORY[1:])}</div>{PLAIN_MENU}</body>"


def test_pages_without_any_hint_are_cut_by_the_smoothed_ratios(monkeypatch):
    assert extract_text(PLAIN_PAGE) == " ".join(STORY)
    monkeypatch.setattr(html_extract, "smooth", lambda ratios, sigma=1.0: ratios)
    assert extract_text(PLAIN_PAGE) != " ".join(STORY)


def test_deep_pages_take_time_in_proportion():
    for page in ("<div>" * 50_000 + "<p>text</p>" * 10, "<blockquote>" * 20_000 + "<p>text" * 20_000, "<div><p>x</span></i>" * 30_000):
        began = time.process_time()
        extract_text(page)
        assert time.process_time() - began < 10
