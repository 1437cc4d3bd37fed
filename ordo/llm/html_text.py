"""Main text of web pages: tag events, text-to-tag ratio, smoothing, clusters.

The standard-library parser streams a page as events.  Block tags cut it into
lines; each line knows its text, the tags seen since the line before, how much
of it is links, and the section it stands in.  The text-to-tag ratio per line is
smoothed with a Gaussian and split into two clusters at the threshold halfway
between their means (iterated).

All ``article`` and ``main`` elements are content.  What stands outside them
comes along only where lines above the threshold hold more than ``OUTWEIGHS``
times their text.  On a page without them the lines above the threshold that are
dense by themselves choose the innermost ``div``, ``section`` or the like that
holds them all, and every line in it is kept; beside it, so are lines above the
threshold and all lines of sections that are not mostly links.  So nothing of an
article is dropped, short parts included (list items, table cells, quotations).

Parts that are never content are skipped while parsing: scripts, styles,
forms, navigation, asides, page headers and footers, and elements whose class,
id or role says advert, menu, notice, sidebar or comments: a name put together
of such words, alone or with words of place and form (``ad-slot``,
``site-footer``).  On a page without another ``article`` or ``main``, those
inside a marked element or form are read (not among comments).  A page of which
nothing is left is read again with marks and forms ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title nav aside footer form button select textarea option datalist "
    "dialog iframe object svg canvas audio video map menu".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul aside".split()
)
REGIONS = frozenset(("article", "main"))
#: Elements that can be the region of a page without ``article`` and ``main``.
SECTIONS = REGIONS | frozenset(("body", "center", "div", "section"))
#: Words of class, id or role that mark an element as no part of the article.
NOT_CONTENT = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored sponsors promo promoted promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup paywall menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead "
    "toolbar comment comments commentlist disqus replies respond share sharing social related recommended "
    "search login contentinfo complementary pagination pager".split()
)
#: Of these, the words that mark what readers wrote; an ``article`` inside is a comment.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words of place and form that a marking word may stand with.
NEUTRAL = frozenset(
    "site page main left right top bottom list box bar slot block unit item items link links area section container wrapper wrap "
    "inner outer user users global primary secondary header head panel group row col zone space".split()
)
#: Names of headers of the whole site.
SITE_HEADERS = (frozenset(("site", "header")), frozenset(("global", "header")), frozenset(("top", "header")))
OUTWEIGHS = 2  # times the text of articles that other text must have to come along
LINKS = 0.5  # share of a section's text in links from which it is a menu
#: Elements of a head; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head".split())
WORD = re.compile(r"[A-Za-z]+")
SHOWN, MARKED, GONE = 0, 1, 2  # an element that is read, one whose class says no content, one that never is content
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}
CHUNK = 1 << 16


def marked(attrs: list[tuple[str, str | None]], region: bool = False) -> int:
    """Says an attribute that this is no content?  ``region``: of an article or main, only by a whole class name."""
    found = SHOWN
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                parts = frozenset([token.lower()] if region else WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
                if parts & NOT_CONTENT and parts <= NOT_CONTENT | NEUTRAL or any(parts >= h for h in SITE_HEADERS) and parts <= NEUTRAL:
                    found = max(found, MARKED if COMMENTS.isdisjoint(parts) else GONE)
        elif name in ("hidden",) or name == "aria-hidden" and value == "true":
            return GONE
    return found


class LineParser(HTMLParser):
    """Collects lines (text, tags before it, in a region or not, section, characters in links) from parser events.

    The places of open elements are kept by tag, so that no event searches the
    stack, however many elements are left open.

    ``inner``: the lines that stand in a region inside a marked element, as
    places in ``lines``.  ``loose``: marks and forms are ignored.
    """

    def __init__(self, loose: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.loose = loose
        self.inner: list[int] = []
        self.lines: list[tuple[str, int, bool, int, int]] = []
        self.open: list[tuple[str, int, int, int]] = []  # tag, element number, SHOWN, MARKED or GONE, marked elements it puts aside
        self.at: dict[str, list[int]] = {}  # places in ``open`` of each tag
        self.blocks: list[int] = []  # places in ``open`` of block elements
        self.pieces: list[str] = []
        self.linked = 0  # characters in links since the last line
        self.n_elements = 0
        self.tags = 0
        self.gone = 0  # open elements that are GONE
        self.marked = 0  # open elements that are MARKED, but those put aside
        self.aside = 0  # marked elements around an open region inside them
        self.regions = 0  # open articles and mains
        self.sections = [0]  # open sections; 0: the page
        self.parents: dict[int, int] = {}  # section around a section
        self.last: dict[int, int] = {}  # last element in a closed section

    def common_section(self, sections: list[int]) -> tuple[int, int]:
        """First and last element of the innermost section that holds all of some."""
        top, last = min(sections), max(sections)  # elements are numbered in the order of their start tags
        while last > self.last.get(top, self.n_elements):
            top = self.parents[top]
        return top, self.last.get(top, self.n_elements)

    def end_line(self) -> None:
        if self.pieces:
            text, linked = " ".join("".join(self.pieces).split()), self.linked
            self.pieces, self.linked = [], 0
            if text:
                if self.aside:
                    self.inner.append(len(self.lines))
                self.lines.append((text, self.tags, self.regions > 0, self.sections[-1], linked))
                self.tags = 0

    def _pop(self) -> None:
        tag, number, kind, put_aside = self.open.pop()
        self.at[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.gone -= kind == GONE
        self.marked -= kind == MARKED
        self.marked += put_aside
        self.aside -= put_aside
        self.regions -= tag in REGIONS
        if tag in SECTIONS:
            self.last[number] = self.n_elements
            self.sections.pop()

    def _end_head(self) -> None:
        while self.at.get("head"):
            self._pop()

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if tag == "body" or self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.end_line()
            self._end_head()
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
            while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self._pop()
            # an unclosed inline element does not outlive its paragraph
            paragraph = self.at.get("p")
            if paragraph and tag in BLOCKS and self.blocks[-1] == paragraph[-1]:
                end = paragraph[-1]
                while len(self.open) > end:
                    self._pop()
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        self.n_elements += 1
        kind = SHOWN
        if tag == "form":
            kind = SHOWN if self.loose else MARKED  # some sites wrap whole pages in one
        elif tag in SKIPPED or tag == "header" and not self.regions:
            kind = GONE
        elif tag not in ("html", "body"):
            kind = marked(attrs, tag in REGIONS)
            if self.loose and (kind == MARKED or not any(name in ("hidden", "aria-hidden") for name, _ in attrs)):
                kind = SHOWN
        # an article or main is read even inside a marked element
        put_aside = self.marked if tag in REGIONS and kind == SHOWN else 0
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, self.n_elements, kind, put_aside))
        self.gone += kind == GONE
        self.marked += (kind == MARKED) - put_aside
        self.aside += put_aside
        self.regions += tag in REGIONS
        if tag in SECTIONS:
            self.parents[self.n_elements] = self.sections[-1]
            self.sections.append(self.n_elements)

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        places = self.at.get(tag)
        if not places:
            return
        if tag not in BLOCKS and tag not in SKIPPED and self.blocks and self.blocks[-1] > places[-1]:
            return  # an inline end tag does not close blocks
        end = places[-1]
        while len(self.open) > end:
            self._pop()

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()  # text is no part of a head either
        if not self.gone and not self.marked:
            self.pieces.append(data)
            if self.at.get("a"):
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, normalised at both ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) < 2:
        return ratios.astype(float)
    over = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / over


def two_clusters(values: np.ndarray) -> float:
    """Threshold halfway between the means of the two clusters it makes."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, float(values.max()))


def parsed(html: str, loose: bool = False) -> LineParser:
    parser = LineParser(loose)
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser.end_line()
    inner = set(parser.inner)
    if any(line[2] and i not in inner for i, line in enumerate(parser.lines)):
        parser.lines = [line for i, line in enumerate(parser.lines) if i not in inner]
        inner = set()
    parser.inner = sorted(inner)
    return parser


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of one page, its blocks joined by newlines; empty if none."""
    if not html:
        return ""
    parser = parsed(html)
    if not parser.lines:
        parser = parsed(html, loose=True)
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    score = smoothed(ratio, sigma)
    cut = two_clusters(score)
    chosen = score >= cut
    inside = np.array([line[2] for line in lines])
    sizes = np.array([len(line[0]) for line in lines])
    # an article inside a marked element does not displace other text
    if inside.any() and sizes[chosen & ~inside].sum() <= OUTWEIGHS * sizes[inside].sum() and not (parser.inner and (chosen & ~inside).any()):
        return "\n".join(line[0] for line in lines if line[2])
    dense = chosen & (ratio >= cut)
    first, last = parser.common_section([lines[i][3] for i in np.flatnonzero(dense if dense.any() else chosen)])
    in_links: dict[int, list[int]] = {}
    for text, _, _, section, linked in lines:
        held = in_links.setdefault(section, [0, 0])
        held[0] += linked
        held[1] += len(text)
    menus = {section for section, (linked, size) in in_links.items() if linked > LINKS * size}
    kept = [line[2] or yes or first <= line[3] <= last or line[3] not in menus for line, yes in zip(lines, chosen, strict=True)]
    return "\n".join(line[0] for line, yes in zip(lines, kept, strict=True) if yes)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    Null or empty html, or a page without content: empty text, 0 characters.
    Repeated pages and null ids or urls stay as they are; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), sigma) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
