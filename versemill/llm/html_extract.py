"""Main-text extraction from raw HTML.

The standard library's streaming parser turns a page into block lines, each with its text length, the number of tags met
in it and the path of open elements. The text-to-tag ratio per line is smoothed with a Gaussian and thresholded by its
standard deviation; lines above form content clusters. A cluster selects its region (the outermost article or main
around it, else the deepest element around all clusters, beside which clustered lines stay too), and all lines of the selected regions are
kept, short ones too, except those inside elements that are never article text. An element that its attributes name as
furniture, a form, a dialog and a hidden element are left out, unless the article is in them; one that is named so only
in part goes if its links or its small share of the clustered text say the same.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("nav header footer aside script style noscript menu button select option textarea input iframe object embed canvas svg math audio video head title dir".split())
UNLESS_ARTICLE = frozenset("form dialog template".split())  # left out too, but for those that the article is in
REGION = frozenset(["article", "main"])
# Words of class, id and role attributes that name page furniture: a name is one if all its words are.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "notice cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond "
    "widget widgets form search complementary contentinfo alert dialog".split()
)
# Those of them that name readers' contributions, which may well be longer than the article.
DISCUSSION = frozenset("comment comments commentlist disqus reply replies respond".split())
# Words that leave a name of furniture what it is, as in ad-slot or reader-comments.
COMPANIONS = frozenset(
    "list area box container wrap wrapper slot inline left right top bottom button buttons link links bar post posts user users reader readers item items section block group panel inner outer unit sticky icon icons "
    "thread count site global holder zone row".split()
)
# Furniture words that name a part of an article as well; of these only the site's own go.
AMBIGUOUS = frozenset("header footer banner form search menu widget widgets notice alert dialog modal promotion masthead".split())
OWNERS = frozenset("site global".split())
_WORDS = re.compile(r"[^\W\d_]+")
SIGMA, RADIUS = 1.0, 3


def furniture_words(attrs: list[tuple[str, str | None]]) -> tuple[set[str], bool]:
    """Furniture words of the class, id and role names that consist of nothing else, or of nothing but companions beside
    them, and whether all such names are of the second kind."""
    found: set[str] = set()
    partly = True
    for k, v in attrs:
        for name in (v or "").lower().split() if k in ("class", "id", "role") else ():
            words = set(_WORDS.findall(name))
            own = words & FURNITURE
            if words <= FURNITURE:
                found |= words
                partly = partly and not words
            elif own and words - own <= (COMPANIONS if own - AMBIGUOUS else OWNERS):
                found |= own
    return found, partly


@dataclass
class _Element:
    """An open or closed element that is no inline one, or that its attributes name as furniture. Numbers ascend in page order."""

    parent: int  # the element around it, itself at the root
    until: int = 0  # the last element in it


@dataclass
class _Named:
    """An element that its attributes name as furniture, or that is left out like one."""

    discussion: bool
    partly: bool  # a name of furniture and companions: the text decides too
    parent: int  # the named element around it, 0 for none
    within: frozenset[str]  # names of the regions around it
    holds: set[str]  # names of the regions in it


@dataclass(frozen=True)
class _Open:
    """What an open element hands on to what is in it."""

    tag: str
    serial: int
    block: int  # the innermost element that is no inline one
    dropped: bool
    named: int  # the innermost named element, 0 for none
    region: int  # the outermost region, 0 for none
    regions: frozenset[str]  # names of the regions around


ROOT = _Open("", 0, 0, False, 0, 0, frozenset())


class _Blocks(HTMLParser):
    """Collects block lines: pieces of text with the named element around each, tags, innermost block and outermost region.

    Every element costs the same, however deep it lies: a line knows only what its element knows.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int]], int, int, int, frozenset[str]]] = []
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements, by name
        self.blocks: list[int] = []  # places of open elements that are no inline ones
        self.linked: Counter[int] = Counter()  # characters inside links, by named element
        self.elements: list[_Element] = [_Element(0)]
        self.named: dict[int, _Named] = {}
        self.tags, self.text = 0, []

    def top(self) -> _Open:
        return self.open[-1] if self.open else ROOT

    def flush(self) -> None:
        if any(text and not text.isspace() for text, _ in self.text):
            at = self.top()
            self.lines.append((self.text, self.tags, at.block, at.region, at.regions))
            self.tags = 0
        self.text = []

    def close_from(self, k: int) -> None:
        for x in self.open[k:]:
            self.at[x.tag].pop()
            self.elements[x.serial].until = len(self.elements) - 1
        del self.open[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(("\n", self.top().named))
        inline = tag in INLINE
        if not inline:
            self.flush()
            # a block start closes an open paragraph with the inline elements left open in it
            if self.blocks and self.open[self.blocks[-1]].tag == (tag if tag in ("li", "dt", "dd", "tr", "td", "th") else "p"):
                self.close_from(self.blocks[-1])
        self.tags += 1
        if tag in VOID:
            return
        around, serial = self.top(), len(self.elements)
        self.elements.append(_Element(around.serial))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        # a heading group inside an article or main is part of it
        dropped = around.dropped or (tag in NEVER and not (tag == "header" and around.regions))
        named, region, regions = around.named, around.region, around.regions
        if tag in REGION and not dropped:
            region, regions = region or serial, regions | {tag}
            if named:
                self.named[named].holds.add(tag)
        elif tag not in ("html", "body") and not dropped:
            words, partly = furniture_words(attrs)
            if words or hidden or tag in UNLESS_ARTICLE:
                self.named[serial] = _Named(bool(words & DISCUSSION), partly and not hidden and tag not in UNLESS_ARTICLE, named, regions, set())
                named = serial
        self.open.append(_Open(tag, serial, around.block if inline else serial, dropped, named, region, regions))
        self.at[tag].append(len(self.open) - 1)
        if not inline:
            self.blocks.append(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if self.at[tag] and not (tag in INLINE and self.blocks and self.blocks[-1] > self.at[tag][-1]):
            self.close_from(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        at = self.top()
        if not at.dropped:
            self.text.append((data, at.named))
            if self.at["a"]:
                self.linked[at.named] += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.flush()
        self.close_from(0)
        self.elements[0].until = len(self.elements) - 1
        for e in sorted(self.named, reverse=True):  # what a named element holds, those around it hold too
            if p := self.named[e].parent:
                self.named[p].holds |= self.named[e].holds


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing, the kernel renormalised at both ends."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(kernel[k + RADIUS], ratios[i + k]) for k in range(-RADIUS, RADIUS + 1) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


@dataclass
class Line:
    text: str
    tags: int
    block: int
    region: int


def without(parser: _Blocks, left_out: set[int]) -> list[Line]:
    """The lines outside the named elements ``left_out``; tags met there count for the next line."""
    gone: dict[int, bool] = {0: False}
    for e in sorted(parser.named):
        gone[e] = e in left_out or gone[parser.named[e].parent]
    out: list[Line] = []
    tags = 0
    for pieces, n, block, region, _ in parser.lines:
        tags += n
        if words := "".join(text for text, named in pieces if not gone[named]).split():
            out.append(Line(" ".join(words), tags, block, region))
            tags = 0
    return out


def clusters(lines: list[Line]) -> tuple[list[float], float, list[int]]:
    """(text-to-tag ratio of each line, threshold, lines whose smoothed ratio reaches it)."""
    own = [len(x.text) / max(1, x.tags) for x in lines]
    ratio = smoothed(own)
    mean = sum(ratio) / len(ratio)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)), max(ratio))
    return own, threshold, [k for k, r in enumerate(ratio) if r >= threshold]


def furniture(parser: _Blocks) -> set[int]:
    """The named elements to leave out: all but those that the article is in.

    One stays that holds most of the clustered text (a discussion only if hardly any is outside it), or that holds a main, or an article, unless that is a related one: inside another article, or in a main with an
    article of clustered text beside it.
    """
    if not parser.named or not (lines := without(parser, set())):
        return set()
    total, whole = 0, Counter()  # characters by named element
    for pieces, *_ in parser.lines:
        for text, named in pieces:
            whole[named] += len(text.strip())
    linked = parser.linked.copy()
    weight: Counter[int] = Counter()  # clustered characters by named element
    beside: dict[int, set[str]] = defaultdict(set)  # names of the regions around clustered lines, by the named element around them

    def common(a: int, b: int) -> int:
        while a != b:  # numbers ascend inwards
            a, b = (parser.named[a].parent, b) if a > b else (a, parser.named[b].parent)
        return a

    for k in clusters(lines)[2]:
        pieces, _, _, _, regions = parser.lines[k]
        for text, named in pieces:
            total += len(text)
            weight[named] += len(text)
        beside[reduce(common, {named for text, named in pieces if not text.isspace()})] |= regions
    for e in sorted(parser.named, reverse=True):
        for sums in (weight, whole, linked):
            sums[parser.named[e].parent] += sums[e]
    outside: dict[int, frozenset[str]] = {0: frozenset()}
    gone = set()
    for e in sorted(parser.named):
        x = parser.named[e]
        outside[e] = outside[x.parent] | beside.get(x.parent, set())
        related = "article" in x.within or ("main" in x.within and "article" in outside[e])
        wins = 2 * weight[e] > total and not (x.discussion and (outside[e] or 10 * (total - weight[e]) > weight[e]))
        # a name in part is no reason by itself: few of the clustered lines, or many links, are
        wins = wins or (x.partly and not x.discussion and 4 * weight[e] > total and 3 * linked[e] < whole[e])
        if not (wins or "main" in x.holds or ("article" in x.holds and not related)):
            gone.add(e)
    return gone


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order joined by two newlines, white space inside a block made one space."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.finish()
    lines = without(parser, furniture(parser))
    if not lines:
        return ""
    own, threshold, content = clusters(lines)
    # every cluster votes for its region
    votes = {lines[k].region for k in content} - {0}
    if votes:
        return "\n\n".join(x.text for x in lines if x.region in votes)
    # the deepest element that holds more than one line and all clustered lines but those lifted by their neighbours only,
    # which would draw in what lies next to the text
    strong = [lines[k].block for k in content if own[k] >= threshold] or [lines[k].block for k in content]
    blocks = sorted(x.block for x in lines)
    region, first, last = strong[0], min(strong), max(strong)

    def holds(e: int) -> bool:
        until = parser.elements[e].until
        return e <= first and last <= until and bisect_right(blocks, until) - bisect_left(blocks, e) > 1

    while region and not holds(region):
        region = parser.elements[region].parent
    until = parser.elements[region].until
    kept = set(content)
    return "\n\n".join(x.text for k, x in enumerate(lines) if region <= x.block <= until or k in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [main_text(h.as_py()) for h in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html is the empty page, whose text is empty; null ids and urls pass through; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored. One map over the rows: nothing is shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
