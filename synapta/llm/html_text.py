"""Main text of web pages by text-to-tag ratios.

The standard library's parser sends its events as it reads a page; block tags and line
feeds end a line, and each line knows its characters of text and its tags. The ratios of text to
tags are smoothed with a Gaussian over neighbouring lines, so a short line between long ones
counts as its surroundings do. Lines at or above a threshold, ``SHARE`` of the standard deviation of the
page's smoothed ratios, are content; runs of such lines are the regions.

Scripts, styles, templates, titles, comments and declarations aren't text. Character references are
decoded. Cases: a null page gives null text, a page without text gives an empty one; unclosed and crossed
tags and broken markup are read as the parser reads them; a null page_id stays null; rows
that repeat are read each; ties of ratios are content or not together, for the threshold counts as reached; an empty table gives no rows;
other columns are ignored, whatever their names. Pages are read whole, however long; marked sections other than CDATA,
like <![endif]--> or <![foo]>, are skipped to their >. Hidden elements may be nested. One that isn't closed by the end of the element around it
or of the page hides nothing, so no text is lost behind it, but for scripts and styles, which are raw text as far as they go;
and like in browsers a drawing ends where an element begins that can't be in one.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import long_ids

RADIUS = 2
SHARE = 0.5
_BLOCK = frozenset(
    "address article aside blockquote body br button caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video".split()
)
_RAW = frozenset(("script", "style"))
_HIDDEN = _RAW | frozenset(("template", "title", "noscript", "svg"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an svg around them.
_NOT_IN_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HTML_IN_SVG = frozenset(("foreignobject", "desc", "title"))


class Lines(HTMLParser):
    """Lines of a page: their text and how many tags they hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.parts: list[str] = []
        self.count = 0
        self.open: Counter[str] = Counter()
        self.hidden = ""
        self.inside: Counter[str] = Counter()  # elements that are open in the hidden one, itself included
        self.held: list[tuple] = []  # what it hides
        self.shown: set[str] = set()  # names that hide nothing, for one of them isn't closed

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text or self.count:
            self.text.append(text)
            self.tags.append(self.count)
        self.parts, self.count = [], 0

    def handle_starttag(self, tag, attrs):
        if self.hidden == "svg" and tag in _NOT_IN_SVG and not any(self.inside[t] > 0 for t in _HTML_IN_SVG):
            self.hidden, self.held = "", []
        if self.hidden:
            self.held.append((self.handle_starttag, tag, attrs))
            self.inside[tag] += tag not in _VOID
            return
        if tag in _HIDDEN and tag not in self.shown:
            self.hidden, self.inside, self.held = tag, Counter((tag,)), []
            return
        if tag in _BLOCK:
            self.end_line()
        self.open[tag] += tag not in _VOID
        self.count += 1

    def handle_startendtag(self, tag, attrs):
        if self.hidden:
            self.held.append((self.handle_startendtag, tag, attrs))
        elif tag not in _HIDDEN:
            if tag in _BLOCK:
                self.end_line()
            self.count += 1

    def handle_endtag(self, tag):
        if self.hidden:
            if self.inside[tag] > 0:
                self.inside[tag] -= 1
                self.held.append((self.handle_endtag, tag))
                if not self.inside[self.hidden]:
                    self.hidden, self.held = "", []
                return
            if not self.open[tag]:
                return
            self.show()  # the end of an element around it
        self.open[tag] -= self.open[tag] > 0
        self.count += 1
        if tag in _BLOCK:
            self.end_line()

    def show(self):
        """Read again what an element hides that isn't closed."""
        while self.hidden:
            self.shown.add(self.hidden)
            held, self.hidden, self.held = self.held, "", []
            for what, *given in held:
                what(*given)

    def handle_data(self, data):
        if self.hidden:
            if self.hidden not in _RAW:
                self.held.append((self.handle_data, data))
            return
        first, *more = data.split("\n")
        self.parts.append(first)
        for line in more:
            self.end_line()
            self.parts.append(line)

    def parse_html_declaration(self, i):
        """As browsers do: marked sections other than CDATA are comments that end at the next >; the library raises at those it doesn't know."""
        if self.rawdata.startswith("<![", i) and self.rawdata[i + 3 : i + 9].lower() != "cdata[":
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def unknown_decl(self, data):
        pass


def lines(html: str) -> tuple[list[str], np.ndarray]:
    """Text and ratio of each line with text or tags."""
    p = Lines()
    p.feed(html)
    p.close()
    p.show()
    p.end_line()
    return p.text, np.array([len(t) / max(1, n) for t, n in zip(p.text, p.tags)])


def smoothed(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian average over the lines around each; at the ends, over those that there are."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2.0 * max(radius, 1) ** 2))
    if not len(x):
        return x
    middle = slice(radius, radius + len(x))
    return np.convolve(x, k)[middle] / np.convolve(np.ones(len(x)), k)[middle]


def content(html: str | None) -> tuple[str | None, int, int]:
    """(text, lines with text or tags, regions of content)."""
    if html is None:
        return None, 0, 0
    text, ratio = lines(html)
    soft = smoothed(ratio)
    good = (soft >= SHARE * soft.std()) & (soft > 0) if len(soft) else np.zeros(0, bool)
    regions = int((good & ~np.concatenate([[False], good[:-1]])).sum())
    return "\n".join(t for t, g in zip(text, good.tolist()) if g and t), len(text), regions


def _udf(batches):
    for b in batches:
        rows = [content(x.as_py()) for x in b.column(1)]
        cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
        yield pa.record_batch([long_ids(b.column(0)), *cols], names=["page_id", "text", "n_lines", "n_regions"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines, n_regions) of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_udf, "page_id long, text string, n_lines int, n_regions int")
