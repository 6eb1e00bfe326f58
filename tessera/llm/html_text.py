"""Main text of web pages from text-to-tag ratios.

The standard parser's events are read once, in page order. A block element's border ends a line,
whatever the source's line breaks; a line keeps its text, how much of it stands in links, how many
tags it took and the element it stands in. The ratio of text to tags of each line outside scripts,
forms, menus and the like is smoothed with a Gaussian over its neighbours, so that short lines
between long ones count with them. Lines over a threshold, a share of the ratio's deviation, are
the content cluster. The region is the innermost element that still holds most of the cluster's
text; an article inside it is preferred, and headings just before the cluster stay with it.
All lines of the region are returned but those of menus, adverts, notices, forms and comments.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's elements without content, and those that end a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never main text.
OUTSIDE = frozenset("aside audio button canvas datalist dialog footer form head iframe label map menu nav noframes noscript object option script search select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what is no main text. Reader comments go even where they are articles.
COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond responses".split())
NAMED = frozenset(
    "ad ads adsbox adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs colophon consent cookie cookiebar cookies copyright dfp dialog disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications optin outbrain overlay pager pagination paywall popup popups promo promotion recommended related search share sharebar sharing sidebar sidenav signup skip skyscraper social sponsor sponsored subscribe subscription taboola toc toolbar topbar tracking widget widgets".split()
)
_SPACE = re.compile(r"[\s\x1c-\x1f]+")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_WHOLE = re.compile(r"[A-Za-z]+")
#: An open tag of these is closed by the next of its kind or a block around it.
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]),
}


class Page(HTMLParser):
    """Elements and lines of a page, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.flag = ["#page"], [-1], [""]  # of each element; flag says why its text is no main text
        self.open = [0]
        self.links = 0
        self.lines: list[list] = []  # text parts, characters in links, tags, element
        self._line()

    def _line(self) -> None:
        # a line without text leaves its tags to the next one
        if not self.lines or self.lines[-1][0]:
            self.lines.append([[], 0, 0, self.open[-1]])
        else:
            self.lines[-1][3] = self.open[-1]

    def handle_starttag(self, tag, attrs):
        self.lines[-1][2] += 1
        if tag in VOID:
            if tag == "hr":
                self._line()
            elif tag != "wbr":
                self._gap()
            return
        if tag in BLOCKS:
            if tag != "head" and "head" in map(self.tag.__getitem__, self.open[1:3]):
                self.handle_endtag("head")  # left open before the body
            if self.tag[self.open[-1]] == "p" or self.tag[self.open[-1]] in HEADINGS and tag in HEADINGS:
                self._close(self.open[-1])  # a paragraph holds no block
            while (by := _CLOSED_BY.get(self.tag[self.open[-1]])) and tag in by:
                self._close(self.open[-1])
        elif tag == "a":
            self.links += 1
            return
        elif tag not in OUTSIDE:
            return  # inline elements need no place in the tree
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.flag.append(_flag(tag, dict(attrs)))
        self.open.append(len(self.tag) - 1)
        if tag in BLOCKS or tag in OUTSIDE:
            self._line()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in OUTSIDE and tag not in BLOCKS or tag == "a":
            self.handle_endtag(tag)  # as <script/> or <svg/>; a block stays open, as browsers have it

    def handle_endtag(self, tag):
        self.lines[-1][2] += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "br":
            self._gap()
        elif tag in BLOCKS or tag in OUTSIDE:
            for k in range(len(self.open) - 1, 0, -1):
                if self.tag[self.open[k]] == tag:
                    self._close(self.open[k])
                    return

    def _close(self, element: int) -> None:
        while self.open.pop() != element:
            pass
        self.links = 0
        self._line()

    def handle_data(self, data):
        if data.strip():
            line = self.lines[-1]
            line[0].append(data)
            if self.links:
                line[1] += len(data)
        else:
            self._gap()

    def _gap(self) -> None:
        if self.lines[-1][0]:
            self.lines[-1][0].append(" ")


def _flag(tag: str, attrs: dict) -> str:
    """`out` for elements never read, `comment` or `named` by class, id or role, else nothing."""
    if tag in OUTSIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return "out"
    names = [attrs.get(a) or "" for a in ("class", "id")]
    words = {w.lower() for name in names for w in _NAME.findall(name) + _WHOLE.findall(name)}  # sideBar is side, bar and sidebar
    if words & COMMENTS:
        return "comment"
    if tag == "header" or words & NAMED or (attrs.get("role") or "").lower() in ROLES:
        return "named"
    return ""


def smoothed(ratio: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """Gaussian mean over the neighbouring lines there are."""
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratio, weight, "full")[radius : radius + len(ratio)] / np.convolve(np.ones(len(ratio)), weight, "full")[radius : radius + len(ratio)]


def main_text(html: str | None, share: float = 0.5, hold: float = 0.7) -> str:
    """The blocks of the main text, one a line.

    share: of the deviation of the smoothed ratio that a line of the cluster exceeds. hold: share of
    the cluster's text that the region keeps. Null and empty pages, and pages without text, give ''.
    """
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    lines = [(text, linked, tags, at) for parts, linked, tags, at in page.lines if (text := _SPACE.sub(" ", "".join(parts)).strip())]
    if not lines:
        return ""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    size = np.array([len(x[0]) for x in lines], np.float64)
    linked = np.minimum(np.array([x[1] for x in lines], np.float64), size)
    at = np.array([x[3] for x in lines])

    # what is outside, from the root down. A wrapper that only has a menu's or a comment's name holds the
    # headline or the main part or, where no article is, nearly all text
    article, headline, much = [False] * n, [False] * n, np.zeros(n)
    shut = [False] * n
    for k in range(1, n):
        shut[k] = shut[parent[k]] or page.flag[k] == "out"
    np.add.at(much, at, np.where(np.array(shut)[at], 0, size))
    for k in range(n - 1, 0, -1):
        up = parent[k]
        article[up] |= article[k] or tag[k] == "article" and page.flag[k] != "comment"
        headline[up] |= headline[k] or tag[k] in ("main", "h1")
        much[up] += much[k]
    outside = [False] * n
    for k in range(1, n):
        wrapper = tag[k] in ("article", "main", "body", "html") if page.flag[k] == "named" else tag[k] in ("main", "body", "html")
        wrapper |= headline[k] or page.flag[k] == "named" and (article[k] or not article[0] and much[k] > 0.9 * much[0])
        outside[k] = outside[parent[k]] or page.flag[k] == "out" or page.flag[k] != "" and not wrapper
    live = ~np.array(outside)[at]
    if not live.any():
        return ""

    # the content cluster
    ratio = np.where(live, size - linked, 0) / np.maximum(1, [x[2] for x in lines])
    smooth = smoothed(ratio)
    content = live & (smooth >= share * smooth.std()) & (linked <= 0.5 * size)
    if not content.any():
        content = live & (linked <= 0.5 * size)
    if not content.any():
        return ""
    mass = np.zeros(n)
    np.add.at(mass, at[content], (size - linked)[content])
    for k in range(n - 1, 0, -1):
        mass[parent[k]] += mass[k]

    # the region
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        children.setdefault(parent[k], []).append(k)
    articles = sorted((mass[k], k) for k in range(1, n) if tag[k] == "article" and mass[k])
    if articles and articles[-1][0] >= 0.3 * mass[0] and (len(articles) == 1 or articles[-2][0] < 0.5 * articles[-1][0]):
        region = articles[-1][1]
    else:
        region = 0
        while best := max(children.get(region, [0]), key=lambda k: mass[k]):
            if mass[best] < hold * mass[0] or tag[best] in HEADINGS or tag[best] == "p":
                break
            region = best
    under = np.zeros(n, bool)
    under[region] = True
    for k in range(region + 1, n):
        under[k] = under[parent[k]]
    keep = live & under[at]
    if tag[region] not in ("article", "main"):
        # no element says where the text ends: from the cluster's first line to its last, with the headings before it
        within = np.flatnonzero(keep & content)
        first, last = within[0], within[-1]
        heading = np.array([tag[k] in HEADINGS for k in at])
        if not heading[first]:
            before = np.flatnonzero(live & heading & (np.arange(len(lines)) < first))
            if len(before) and (tag[at[before[-1]]] == "h1" or parent[at[before[-1]]] == region):
                first = before[-1]
                keep[first] = True
        keep &= (np.arange(len(lines)) >= first) & (np.arange(len(lines)) <= last)
    # lists of links are menus, wherever they stand
    listed = np.array([tag[k] == "li" for k in at]) & (linked > 0.5 * size)
    keep &= ~listed
    return "\n".join(lines[k][0] for k in np.flatnonzero(keep))


def extract(pages: DataFrame, share: float = 0.5, hold: float = 0.7) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    A null or empty html gives ''; rows that repeat are read each, an empty table gives an empty one.
    A page is read whole, whatever its length; only page_id, url and html are read.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                texts = [main_text(h.as_py(), share, hold) for h in some.column("html")]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
