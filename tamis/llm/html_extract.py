"""Main text of web pages, by text-to-tag ratios of the lines that a streaming parser yields.

The standard library's parser sends events; block tags cut them into lines, each with its characters, its tags and the
container it stands in. Lines inside elements that never hold main text (menus, scripts, ...) or whose class, id or role
says so are set aside as they come. The ratio of characters to tags per line is smoothed with a Gaussian and cut at a
threshold in units of its deviation; the lines above it cluster into content regions. Where a page marks articles, the
one that holds most of the clustered text is taken whole, short lines included. Else the text runs from the first
clustered line to the last, with the headings that lead to it and the short lines between; lines before and after it are
not main text, whatever their tags say. Text in forms counts where it is most of the page, as in pages that are one form.

Defined results: a null or empty page, or one without such a region, gives an empty text. Character references are
decoded, white space inside a block becomes one blank, blocks are trimmed and joined in page order by one blank; nothing
else is dropped, and nothing is capped. Unclosed tags end with their parent. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text; forms are judged by their share of the page.
_SKIP = frozenset("script style noscript template iframe object svg canvas audio video nav aside footer button select textarea input dialog menu head title".split())
#: Words of a class, id or role that mark what is not main text.
_NOISE = frozenset(
    "advert adverts advertisement advertising sponsor sponsored banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments replies respond disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup recommended recommendations toolbar pagination pager login searchbox complementary contentinfo dialog".split()
)
#: Those that do so only alone or beside words of layout: "ad-slot" and "related-posts", not "ad-hoc" and "related-work".
_AMBIGUOUS = frozenset("ad ads adv promo promotion side reply notice notices alert share sharing social related widget search skip".split())
_PLACE = frozenset("area articles bar block bottom box button buttons card column container content footer group header inner item items left link links list main middle module outer panel pane placeholder post posts right row section site slot stories story text top unit widget widgets wrap wrapper zone".split())
#: Those that layout wrappers of the article may carry too.
_LAYOUT = frozenset("sidebar side header footer nav menu banner widget notice ad ads".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text, which are no containers of a region.
_TEXT = _HEADINGS | frozenset("p li dt dd td th tr caption pre blockquote center address figcaption legend summary option".split())
#: Start tags that end an open element of the second kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select article section div body main".split())
_IN_P = _BLOCK - {"br", "td", "th", "tr", "caption", "option", "optgroup", "legend", "summary", "body", "html", "head", "title"}
_WORD = re.compile(r"[a-z0-9]+")
_CUT_TAG = re.compile(r"</?[a-zA-Z][^>]*\Z")


@dataclass
class Line:
    text: str
    tags: int
    box: int  # number of the innermost container that is no block of text, 0 for the page
    article: int  # number of the innermost article container, or -1
    heading: bool
    form: bool


@dataclass
class _Open:
    """An open element and what it makes of the text in it."""

    tag: str
    number: int
    aside: str  # why the text is set aside
    article: int
    box: int
    heading: bool
    form: bool


def is_noise(value: str, article: bool) -> str:
    """The word of a class, id or role that sets an element aside, if any; a word of layout only without a stronger one."""
    found = set()
    for words in map(_WORD.findall, value.lower().split()):
        if words and words[0] not in ("has", "with", "no", "without"):
            found |= _NOISE.intersection(words)
            unsure = _AMBIGUOUS.intersection(words)
            if unsure and all(w in unsure or w in _PLACE or w in _NOISE or w.isdigit() for w in words):
                found |= unsure
    if article:
        found -= {"header"}
    return min(found - _LAYOUT, default=min(found, default=""))


class LineParser(HTMLParser):
    """Lines of main-text candidates of one page. Every event takes time that does not depend on the depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.ends: dict[int, int] = {}  # the last container inside each closed one
        self._page = _Open("", 0, "", -1, 0, False, False)
        self._open: list[_Open] = []
        self._count: Counter[str] = Counter()  # of open tags
        self._buffer: list[str] = []
        self._tags = self._number = 0
        self._top = self._page

    def _cut(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer.clear()
            if text:
                top = self._top
                self.lines.append(Line(text, self._tags, top.box, top.article, top.heading, top.form))
                self._tags = 0

    def _why(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in _SKIP:
            return "element"
        article = self._top.article >= 0
        if tag == "header":
            return "" if article else "header"
        if tag in ("html", "body", "main", "h1") or not attrs:
            return ""
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if why := is_noise(value, article):
                    return why
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return "hidden"
        return ""

    def _push(self, tag: str, why: str) -> None:
        top, self._number = self._top, self._number + 1
        aside, article = top.aside, top.article
        if tag in ("article", "main") and not why:
            if aside in _LAYOUT:
                aside = ""
            if not aside:
                article = self._number
        box = top.box if tag in _TEXT or tag not in _BLOCK else self._number
        self._top = _Open(tag, self._number, aside or why, article, box, top.heading or tag in _HEADINGS, top.form or tag == "form")
        self._open.append(self._top)
        self._count[tag] += 1

    def _pop_to(self, at: int) -> None:
        for x in self._open[at:]:
            self._count[x.tag] -= 1
            self.ends[x.number] = self._number
        del self._open[at:]
        self._top = self._open[-1] if self._open else self._page

    def inside(self, line: Line, box: int) -> bool:
        """Whether the line stands in a container: the containers inside one have the numbers that follow it."""
        return box <= line.box <= self.ends.get(box, self._number)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _BLOCK:
            self._cut()
            closes = _CLOSES.get(tag, ())
            if any(self._count[x] for x in closes) or tag in _IN_P and self._count["p"]:
                for at in range(len(self._open) - 1, -1, -1):
                    if (name := self._open[at].tag) in closes or name == "p" and tag in _IN_P:
                        self._pop_to(at)
                        break
                    if name in _SCOPE:
                        break
        if tag in _VOID:
            return
        why = self._why(tag, attrs)
        if tag in _BLOCK or why:
            if why:
                self._cut()
            self._push(tag, why)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in _BLOCK:
            self._cut()
        if self._count[tag]:
            at = len(self._open) - 1
            while self._open[at].tag != tag:
                at -= 1
            self._cut()
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self._top.aside:
            self._buffer.append(data)

    def close(self) -> None:
        if _CUT_TAG.match(self.rawdata):  # the page ends inside a tag
            self.rawdata = ""
        super().close()
        self._cut()


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    same = lambda x: np.convolve(x, kernel)[reach:-reach]
    return same(ratios) / same(np.ones(len(ratios)))


def content_lines(parser: LineParser, factor: float = 0.5, lead: int = 2) -> list[Line]:
    """The lines of the main content region."""
    lines = [x for x in parser.lines if not x.form]
    if sum(len(x.text) for x in lines) < sum(len(x.text) for x in parser.lines if x.form):
        lines = parser.lines
    if not lines:
        return []
    chars = np.array([len(x.text) for x in lines], dtype=float)
    smoothed = smooth(chars / np.maximum(1, [x.tags for x in lines]))
    chosen = smoothed >= min(smoothed.max(), factor * smoothed.std())
    articles = {x.article for x in lines if x.article >= 0}
    if articles:
        mass = {a: sum(c for x, c, k in zip(lines, chars, chosen, strict=True) if k and parser.inside(x, a)) for a in sorted(articles)}
        best = max(mass, key=lambda a: (mass[a], -a))
        return [x for x in lines if parser.inside(x, best) and x.article >= 0]
    start, end = np.flatnonzero(chosen)[[0, -1]]
    for k in range(start - 1, max(-1, start - 1 - lead), -1):
        if lines[k].heading:
            start = k
    return lines[start : end + 1]


def extract_text(html: str | None) -> str:
    parser = LineParser()
    parser.feed(html or "")
    parser.close()
    return " ".join(x.text for x in content_lines(parser))


def main_text(html: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract_text, na_action=None).astype(object)

    return F.pandas_udf(run, "string").asNondeterministic()(html)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` without its html, with the main text of each (a column of that name is replaced)."""
    return pages.withColumn(text_col, main_text(F.col(html_col))).drop(html_col)
