"""Main-text extraction from HTML: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

One pass of the standard library's event parser turns a page into lines, one for each block of text, with the number of tags seen in
it, its characters inside links, and the container around it. A line's ratio is its characters outside links by its tags. Scripts,
styles and what is never shown have no lines. Lines in navigation, headers, footers, sidebars, forms, and in elements whose class, id or
role says advert, notice, menu or comments, have ratio 0 as their text is markup: a class token says so if all of its words do, and no
class counts on an element that holds half of the page's content or more, unless an ``article`` or ``main`` has text outside it.

The ratios are smoothed with a Gaussian kernel; lines above a threshold (the deviation of the smoothed ratios, capped by their mean) are
content and vote with their text for the smallest container that holds nearly all of it. Lists, tables and data cells do not stand for
election, as they are parts of an article. The article is the outermost ``article`` (or else ``main``) around the winner, or else the
outermost container below the body that adds only content lines, paragraphs and headings; where only the page's body holds the text, it
is the region from the first to the last content line. Inside, lines stay however short, but for clusters of links: lines that are links
for the most part, with a ratio below the threshold, two or more in a row or of two or more links, go with the box that holds them or the
heading above them. So do single such lines at the ends of a region.

Defined results: a null or empty page, or one without content, gives an empty text; tags never closed end with their container
or the page; pages are parsed whole, in time and memory linear in their length however deep they nest; repeated rows are parsed one by
one; null ids and urls are kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import kernel
from keyloom.llm.common import table, workers_find_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown, or not text.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select textarea".split())
#: Shown, but not the article.
ASIDE = frozenset("nav header footer aside form button dialog menu".split())
CONTAINERS = frozenset("html body main article section div td th table tbody thead tfoot tr ul ol dl center".split()) | SILENT | ASIDE
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figure figcaption fieldset legend details summary hr caption".split())
#: Words of class, id and role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share sharing "
    "social footer header masthead comment comments reply replies respond disqus login signup search searchbox toolbar pagination pager skip copyright complementary contentinfo".split()
)
PAGE = ("html", "body")
#: Containers that are parts of an article. A cell that holds a heading lays out the page and may hold the article.
PARTS = frozenset("td th table tbody thead tfoot tr ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre figcaption".split())
_WORD = re.compile(r"[A-Za-z]+")


def _marked(attrs: list) -> bool:
    return any((words := _WORD.findall(token.lower())) and all(w in MARKED for w in words) for k, v in attrs if k in ("class", "id", "role") and v for token in v.split())


class _Lines(HTMLParser):
    """Collects the lines of a page (text, tags, characters in links, links, container, block) and its containers, numbered as they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, str]] = []
        self.names: list[str] = ["page"]
        self.parent: list[int] = [0]
        self.hint: list[int] = [0]  # 0, or 1 by name, or 2 by class
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, container, silent
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.block = ""
        self.tags = self.linked = self.links = self.anchors = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.links, self.stack[-1][1], self.block))
        self.parts, self.tags, self.linked, self.links = [], 0, 0, int(self.anchors > 0)

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            self.tags += 1
            return
        own = tag in ("html", "body", "main", "article")
        hint = 0 if own or tag == "header" and (self.open["article"] or self.open["main"]) else 1 if tag in ASIDE else 2 if _marked(attrs) else 0
        if tag in BLOCKS:
            self.flush()
            self.block = tag
            if self.stack[-1][0] in ("p", tag if tag == "li" else "p"):  # a marked paragraph or item ends here
                self._pop()
        if tag in CONTAINERS or hint:
            self.stack.append((tag, len(self.names), self.stack[-1][2] or tag in SILENT))
            self.parent.append(self.stack[-2][1])
            self.names.append(tag)
            self.hint.append(hint)
            self.open[tag] += 1
        if tag == "a":
            self.anchors = 1
            self.links += 1
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.block = ""
        if tag == "a":
            self.anchors = 0
        self.tags += 1
        if self.open[tag] > 0:
            self.flush()
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(" ".join(data.split()))


def smoothed(ratio: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """``ratio`` under a normalised Gaussian kernel, edges renormalised."""
    kernel_ = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    pad = lambda x: np.convolve(np.pad(x, radius), kernel_, "valid")
    return pad(ratio) / pad(np.ones(len(ratio)))


class _Page:
    """The lines of a page with their ratios, clusters, and the ranges of lines that containers hold."""

    def __init__(self, html: str):
        parser = _Lines()
        parser.feed(html)
        parser.close()
        parser.flush()
        self.texts = [x[0] for x in parser.lines]
        self.names, self.parent, hint = parser.names, parser.parent, parser.hint
        self.blocks = [x[5] for x in parser.lines]
        if not self.texts:
            return
        tags, linked, self.links, self.of = (np.array([x[k] for x in parser.lines]) for k in (1, 2, 3, 4))
        self.chars = np.array([len(t) for t in self.texts], float)
        self.linked = np.minimum(linked, self.chars)
        self.begin, self.end = self._ranges()
        ratio = (self.chars - self.linked) / np.maximum(1, tags)
        named = self._inside([h == 1 for h in hint])
        _, content = self._clusters(np.where(named, 0.0, ratio), named)
        half, votes = 0.5 * self.chars[content].sum(), self._votes(content)
        main = np.concatenate([[0], np.cumsum(self._inside([n in ("article", "main") for n in self.names]) & ~named)])
        elsewhere = main[-1] - main[self.end] + main[np.minimum(self.begin, self.end)]  # lines of an article outside each container
        aside = self._inside([h == 1 or h == 2 and (votes[c] < half or elsewhere[c] > 0) for c, h in enumerate(hint)])
        self.ratio = np.where(aside, 0.0, ratio)
        self.aside = aside
        self.threshold, self.content = self._clusters(self.ratio, aside)
        self.votes = self._votes(self.content)

    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """The first line of each container and the one after its last: what is inside comes in one piece."""
        first, end = [len(self.texts)] * len(self.names), [0] * len(self.names)
        for i, c in enumerate(self.of.tolist()):
            first[c], end[c] = min(first[c], i), i + 1
        for c in range(len(first) - 1, 0, -1):
            p = self.parent[c]
            first[p], end[p] = min(first[p], first[c]), max(end[p], end[c])
        return np.array(first), np.array(end)

    def _inside(self, own: list[bool]) -> np.ndarray:
        """Lines inside containers of which ``own`` is true."""
        inside = list(own)
        for c in range(1, len(inside)):
            inside[c] = inside[c] or inside[self.parent[c]]
        return np.array(inside)[self.of]

    def _clusters(self, ratio: np.ndarray, aside: np.ndarray) -> tuple[float, np.ndarray]:
        smooth = smoothed(ratio)
        threshold = float(min(smooth.std(), smooth.mean()))
        return threshold, (smooth >= threshold) & ~aside

    def _votes(self, content: np.ndarray) -> np.ndarray:
        votes = np.bincount(self.of, np.where(content, self.chars, 0.0), len(self.names)).tolist()
        for c in range(len(votes) - 1, 0, -1):
            votes[self.parent[c]] += votes[c]
        return np.array(votes)

    def article(self, share: float) -> int | None:
        """The container of the article."""
        need = share * self.votes[0]
        headed = set()
        for i, block in enumerate(self.blocks):
            c = int(self.of[i])
            while block in HEADINGS and c and c not in headed:
                headed.add(c)
                c = self.parent[c]
        able = [c for c, n in enumerate(self.names) if c and self.votes[c] >= need and n not in PAGE and (n not in PARTS or n == "td" and c in headed)]
        if not able or not need:
            return None
        own = able[-1]  # the innermost is numbered last
        above = []
        c = self.parent[own]
        while c:
            above.append(c)
            c = self.parent[c]
        for kind in ("article", "main"):
            if named := [c for c in (own, *above) if self.names[c] == kind]:
                return named[-1]
        low, high, chosen = int(self.begin[own]), int(self.end[own]), own
        for c in above:
            if self.names[c] in PAGE:
                break
            more = [*range(int(self.begin[c]), low), *range(high, int(self.end[c]))]
            if not all(self.content[i] or self.blocks[i] in PROSE and not self.aside[i] for i in more):
                break
            low, high = int(self.begin[c]), int(self.end[c])
            if self.names[c] not in PARTS:
                chosen = c
        return chosen

    def kept(self, share: float) -> np.ndarray:
        """Whether each line belongs to the article."""
        article = self.article(share)
        at = np.flatnonzero(self.content)
        out = np.zeros(len(self.texts), bool)
        if article is None and not len(at):
            return out
        low, high = (int(self.begin[article]), int(self.end[article])) if article is not None else (int(at[0]), int(at[-1]) + 1)
        out[low:high] = True
        out &= ~self.aside
        link = out & (2 * self.linked >= self.chars) & (self.ratio < self.threshold)
        while article is None and low < high and link[low]:
            out[low], low = False, low + 1
        while article is None and high > low and link[high - 1]:
            out[high - 1], high = False, high - 1
        i = low
        while i < high:
            to = i
            while to < high and link[to]:
                to += 1
            if to - i >= 2 or to > i and self.links[i] >= 2:
                out[i:to] = False
                box, top = int(self.of[i]), article or 0
                while box != top and box and self.names[box] not in PAGE and not (self.begin[box] < i and self.end[box] >= to):
                    box = self.parent[box]  # the smallest container with something above the links
                low_box, high_box = int(self.begin[box]), int(self.end[box])
                if box not in (top, 0) and self.names[box] not in PAGE and 2 * self.linked[low_box:high_box].sum() >= self.chars[low_box:high_box].sum():
                    out[low_box:high_box] = False
                elif i > low and self.blocks[i - 1] in HEADINGS:
                    out[i - 1] = False
            i = max(to, i + 1)
        return out


def extract(html: str | None, share: float = 0.8) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    page = _Page(html)
    if not page.texts:
        return ""
    return "\n\n".join(page.texts[i] for i in np.flatnonzero(page.kept(share)))


def extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    workers_find_package(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.slices(batches, "html"):
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(kernel.trimmed(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(table(spark, sf_dir, "pages"))
