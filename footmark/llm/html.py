"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block elements end a line.  Each line has its text, its number of tags
and the region (innermost sectioning element) it stands in.  The ratio of text to tags is smoothed with a Gaussian
along the lines of a page, two-means clustering of the smoothed ratios gives the page's threshold, and regions are
selected whose lines reach it.  Regions that a page marks as its article count as dense; those marked as menus,
headers, footers, sidebars, notices, adverts, forms, scripts or reader comments never count.  A selected region is
returned whole, so short paragraphs of an article stay.

Nulls and edge cases: a null or empty page has an empty text; text outside any element is a region of its own;
unclosed or stray tags do no harm; character references are decoded; white space inside a block becomes one space;
repeated rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = set("article main section div body td nav header footer aside form menu dialog".split())
SKIPPED = set("nav footer aside form menu dialog script style noscript template head title button select option textarea "
              "iframe object svg canvas audio video".split())
BLOCKS = REGIONS | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tr th blockquote pre hr figure figcaption "
                       "address details summary fieldset legend html head title center label".split())
BOILERPLATE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
                  "breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus replies respond cookie cookies "
                  "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing "
                  "social related recommended login signin signup register search widget toolbar pagination pager tags copyright "
                  "skip legal".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
CONTENT = set("article content post entry story main body text".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Line:
    region: int
    skipped: bool
    tags: int = 0
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


class Lines(HTMLParser):
    """Lines of a page in order, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # element, region, skipped, within the marked article
        self.marked: list[bool] = [False]  # by region: the page says it is its article
        self.links = 0
        self.lines: list[Line] = []
        self.begin()

    def begin(self) -> None:
        _, region, skipped, _ = self.open[-1] if self.open else ("", 0, False, False)
        self.line = Line(region, skipped)
        self.lines.append(self.line)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self.line.tags += 1
        if tag == "a":
            self.links += 1
        if tag in VOID:
            if tag == "hr":
                self.begin()
            elif tag == "br":
                self.line.parts.append(" ")
            return
        if tag in REGIONS or tag in SKIPPED or tag in HEADINGS:
            self.enter(tag, dict(attrs))
        if tag in BLOCKS:
            self.begin()

    def enter(self, tag: str, attrs: dict) -> None:
        _, region, skipped, article = self.open[-1] if self.open else ("", 0, False, False)
        names = [w.lower() for k in ("class", "id") for w in WORD.findall(attrs.get(k) or "")]
        said = tag in ("article", "main") or tag in REGIONS and bool(CONTENT & set(names)) and tag != "body"
        role = (attrs.get("role") or "").lower()
        if tag in HEADINGS and article and self.open and self.open[-1][0] == "header":
            skipped = self.open[-1][2] and any(x[2] for x in self.open[:-1])  # the headline in an article's own header
        elif tag not in ("body", "html"):
            skipped = (skipped or tag in SKIPPED or tag == "header" or role in BOILERPLATE_ROLES
                       or bool(BOILERPLATE & set(names)) and tag not in ("article", "main"))
        if tag in REGIONS and not (article and not said):
            region = len(self.marked)
            self.marked.append(said and not skipped)
        self.open.append((tag, region, skipped, article or said and not skipped))

    def handle_endtag(self, tag):
        self.line.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in BLOCKS:
            self.begin()

    def handle_data(self, data):
        if self.open and self.open[-1][2] and not self.line.skipped:
            return  # a script or button within a block that counts
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach)
    weight = np.convolve(np.pad(np.ones(len(values)), reach), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def threshold(values: np.ndarray) -> float:
    """Middle between the two means of a two-means clustering."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values > (low + high) / 2
        if not upper.any() or upper.all():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Blocks of the article, one a line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = []
    for line in parser.lines:
        line.text = " ".join("".join(line.parts).split())
        if line.text and not line.skipped:
            lines.append(line)
    if not lines:
        return ""
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    dense = smooth(ratio, sigma)
    named = np.array([parser.marked[x.region] for x in lines])
    if named.any():  # the page says which regions are its article
        dense = np.where(named, max(float(dense.max()), 1.0), 0.0)
    level = np.log1p(dense)
    chosen = level >= threshold(level)
    regions = {x.region for x, c in zip(lines, chosen) if c}
    return "\n".join(x.text for x in lines if x.region in regions)


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars."""

    def work(batches):
        for batch in slices(batches, "html"):
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"),
                   "text": [main_text(h, sigma) for h in batch.column("html").to_pylist()]}

    found = arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), work, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
