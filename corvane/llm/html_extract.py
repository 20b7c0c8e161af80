"""Main text of HTML pages by content-to-tag ratios.

The standard library's streaming parser gives events; block elements cut them to lines, each with its text and its number of
tags. A line's ratio is characters per tag; ratios are smoothed along the page by a Gaussian, and lines at or above the
threshold (the standard deviation of the smoothed ratios) are the content cluster. The region is the deepest container that holds every line of the
cluster, or the article or main element around it; its lines are the text, in page order, without those inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments. In a page whose region is the body itself, lines of links alone before the first
and after the last clustered line aren't part of it.

What is left out for its element or role is left out always. A block that only its class or id, or being a form, speaks against is a suspect. A class or id speaks
against a block if it says nothing else: every part of the name is a word for such blocks or for a place on a page ("site-footer", "ad-slot"; not
"social-science" or "notice-of-intent"). A suspect that holds the whole content cluster and over KEPT of the page's text is the content, unless it is named for
comments: some sites wrap the whole page in a form, or name its column by chance.

Elements are numbered in page order with their parent's number, so that an event takes constant time and the region one pass, however deep the
page is nested. White space (any of Unicode's, such as no-break spaces) inside a block becomes one space, character references are decoded, blocks are joined by two \\n. Edge cases: a
null or empty page, or one without text, gives an empty text; unclosed and misnested elements end with their container; cut-off pages give what they have;
repeated rows each give a row; other columns, of any name, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches

SIGMA = 1.0

# HTML elements by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside script style noscript template iframe object svg math button select textarea head title dialog menu search audio video canvas".split())
CONTAINERS = frozenset("article main section div body td form".split())
ENDS_P = BLOCKS - {"html", "body", "option", "optgroup"}
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
SUSPECT_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended newsletter subscribe "
    "subscription signup login widget widgets pagination pager search skip copyright".split()
)
#: Words for a place or a kind of block; beside a suspect's name they say nothing else.
PLACE_NAMES = frozenset(
    "site page global main primary secondary left right top bottom upper lower inner outer wrapper wrap container content box bar block area section column col panel pane slot unit zone item items "
    "link links button buttons icon icons list group row post posts article articles entry story stories user reader blog form message text label title heading header js is has".split()
)
KEPT = 2 / 3


def suspects(value: str) -> int:
    """2 if a class or id names comments, 1 if it names another block that is left out, else 0."""
    worst = 0
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if p]
        if parts and parts != ["skip", "list"] and all(p in SUSPECT_NAMES or p in PLACE_NAMES for p in parts) and (named := SUSPECT_NAMES.intersection(parts)):
            worst = max(worst, 2 if named & COMMENT_NAMES else 1)
    return worst


class _Line:
    __slots__ = ("pieces", "tags", "node", "linked")

    def __init__(self, node: int):
        self.pieces: list[str] = []
        self.tags = 0
        self.linked = 0  # 1 with words in links, 2 with words outside, 3 with both
        self.node = node

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Lines(HTMLParser):
    """Lines of a page from parser events. Element 0 is the page; a list has a value for each element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth = [""], [-1], [0]
        self.out = [False]  # left out whatever else the page holds
        self.article = [False]  # an article or main element, or inside one
        self.suspect = [-1]  # the outermost suspect that the element is or is in
        self.comments = [False]
        self.open: dict[str, int] = {}  # open elements by tag
        self.node = 0
        self.lines: list[_Line] = []
        self.line = _Line(0)
        self.link = False

    def _new_line(self) -> None:
        if self.line.pieces:
            self.lines.append(self.line)
            self.line = _Line(self.node)
        self.line.node = self.node
        self.link = False

    def _judge(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, int]:
        """Whether an element is left out, and what its name or being a form says against it."""
        if tag in LEFT_OUT:
            return True, 0
        if tag == "header":
            return not self.article[self.node], 0
        if tag in ("html", "body", "article", "main"):
            return False, 0
        worst = int(tag == "form")
        for key, value in attrs:
            value = value or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                return True, 0
            if key == "role" and value.lower() in LEFT_OUT_ROLES:
                return True, 0
            if key in ("class", "id"):
                worst = max(worst, suspects(value))
        return False, worst

    def _push(self, tag: str, out: bool, worst: int) -> None:
        at = self.node
        self.node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(at)
        self.depth.append(self.depth[at] + 1)
        self.out.append(self.out[at] or out)
        self.article.append(self.article[at] or tag in ("article", "main"))
        self.suspect.append(self.suspect[at] if self.suspect[at] >= 0 else self.node if worst else -1)
        self.comments.append(self.comments[at] or worst == 2)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, node: int) -> None:
        """Close the open elements up to and with ``node``."""
        at = self.node
        while at != node:
            self.open[self.tag[at]] -= 1
            at = self.parent[at]
        self.open[self.tag[node]] -= 1
        self.node = self.parent[node]
        self._new_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close("p", frozenset(("div", "td", "th", "li", "section", "article", "blockquote", "body")))
        if tag in BLOCKS or tag in LEFT_OUT:
            if tag in ("li", "td", "th", "tr", "dt", "dd"):
                self._close(tag, frozenset(("ul", "ol", "table", "dl", "menu")))
            if tag not in VOID:
                self._push(tag, *self._judge(tag, attrs))
            self._new_line()
        elif tag not in VOID and not self.out[self.node] and any(said := self._judge(tag, attrs)):
            # An inline element that is left out or a suspect, such as a span of an advert, is an element of its own.
            self._push(tag, *said)
            self._new_line()
        elif tag == "br":
            self.line.pieces.append(" ")
        elif tag == "a":
            self.link = True
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close(self, tag: str, walls: frozenset[str]) -> None:
        if not self.open.get(tag):
            return
        at = self.node
        while at and self.tag[at] != tag:
            if self.tag[at] in walls:
                return
            at = self.parent[at]
        if at:
            self._pop_to(at)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag == "a":
            self.link = False
        if tag in ("html", "body"):
            return
        if self.open.get(tag):
            at = self.node
            while self.tag[at] != tag:
                at = self.parent[at]
            self._pop_to(at)
        elif tag in BLOCKS:
            self._new_line()

    def handle_data(self, data: str) -> None:
        if not self.out[self.node]:
            self.line.pieces.append(data)
            if any(map(str.isalnum, data)):
                self.line.linked |= 1 if self.link else 2

    def finish(self) -> list[_Line]:
        self.close()
        self._new_line()
        return self.lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    around = np.pad(ratios, reach, mode="edge")
    return np.convolve(around, weights / weights.sum(), mode="valid")


def _cluster(lines: list[tuple[_Line, str]]) -> np.ndarray:
    """The positions of the lines in the content cluster."""
    ratios = smooth(np.array([len(t) / max(1, line.tags) for line, t in lines]))
    seeds = np.flatnonzero(ratios >= ratios.std())
    return seeds if len(seeds) else np.arange(len(lines))


def _region(page: Lines, nodes: list[int]) -> int:
    """The article or main element around the deepest container that holds all the nodes, else that container, else 0."""
    first = set()
    at = nodes[0]
    while at >= 0:
        first.add(at)
        at = page.parent[at]
    met: dict[int, int] = {}  # the lowest element of the first one's path that is around each
    common = nodes[0]
    for node in nodes[1:]:
        path, at = [], node
        while at not in first and at not in met:
            path.append(at)
            at = page.parent[at]
        to = met.get(at, at)
        met.update(dict.fromkeys(path, to))
        if page.depth[to] < page.depth[common]:
            common = to
    while common > 0 and page.tag[common] not in CONTAINERS:
        common = page.parent[common]
    around = common
    while around > 0 and page.tag[around] not in ("article", "main"):
        around = page.parent[around]
    return max(around, 0) or max(common, 0)


def extract(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    every = [(line, text) for line in page.finish() if not page.out[line.node] and (text := line.text())]
    if not every:
        return ""
    held = [page.suspect[line.node] for line, _ in every]
    content = -1
    if any(h >= 0 for h in held):
        around = {held[k] for k in _cluster(every)}
        if len(around) == 1 and (one := around.pop()) >= 0 and not page.comments[one]:
            text = sum(len(t) for _, t in every)
            content = one if sum(len(t) for (_, t), h in zip(every, held, strict=True) if h == one) > KEPT * text else -1
    kept = [x for x, h in zip(every, held, strict=True) if (h < 0 or h == content) and not page.comments[x[0].node]]
    if not kept:
        return ""
    seeds = _cluster(kept)
    region = _region(page, [kept[k][0].node for k in seeds])
    if page.tag[region] in ("", "body"):
        first, last = int(seeds[0]), int(seeds[-1])
        while first and page.tag[kept[first - 1][0].node] in ("h1", "h2"):
            first -= 1
        return "\n\n".join(t for i, (line, t) in enumerate(kept) if first <= i <= last or line.linked != 1)
    inside = [False] * len(page.tag)
    for k in range(region, len(page.tag)):
        inside[k] = k == region or inside[page.parent[k]]
    return "\n\n".join(t for line, t in kept if inside[line.node])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return raw.mapInArrow(run, "page_id long, url string, text string, n_chars long")
