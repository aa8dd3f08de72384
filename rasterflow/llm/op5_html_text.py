"""Main text of pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each block. A
line's text-to-tag ratio is its characters outside links over the tags met since the line before
it. The ratios are smoothed with a Gaussian and clustered by a threshold. Each container is weighed
by the lines in it, those above the threshold for it and those below against it; the
container that weighs most is the content region. Only where containers weigh much the same do tag
names decide (article and main before others), and then the innermost.

Inside the region the clusters decide lines. A run of lines of links whose smoothed ratios fall below the threshold (a menu, a
list of other articles) is left out, a single one between paragraphs is lifted above it by them and stays. A block whose class names it a notice, an advert or
the like is left out unless its own ratio is that of a paragraph. A container named so is left out unless it holds half of the
page's clustered text; one named as reader comments or advert is left out unless next to nothing were left without it.
All other lines of the region belong to the text, however short.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: HTML elements by what they mean for text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video textarea select datalist button map".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
#: Of these some are left open by mistake or hold a whole page; an article inside begins anew.
WRAPPERS = frozenset("nav header form menu".split())
REGIONS = frozenset("article main".split())
#: Blocks that hold other blocks and so can be a content region.
CONTAINERS = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figure footer form header hgroup html main menu nav ol section table tbody td tr ul".split())
#: Words that mark even an article as something else than the page's own.
FOREIGN = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies respond disqus teaser".split())
#: Words in class, id or role that mark boilerplate, unless nothing were left without it.
STRONG = FOREIGN - {"promo", "related", "recommended", "teaser"} | {"adsense", "adverts", "commentlist"}
#: Words in class, id or role that mark boilerplate, unless it holds half of the page's clustered text: then they name a part of the layout.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar sidenav widget related recommended recommendations comment comments commentlist disqus respond replies reply discussion share sharing social newsletter subscribe"
    " subscription signup login breadcrumb breadcrumbs menu nav navbar navigation toolbar pagination pager masthead header footer copyright search complementary contentinfo skip".split()
)
#: Words that make a class a state of the page: comments-open and ad-free name no comments and no advert.
STATES = frozenset("no non not has have is with without free open opened closed on off enabled disabled allow allowed show shown hide less supported ready status count".split())
_CLOSES_P = BLOCKS - {"html", "body", "caption", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: The pages of the test tables have one article of plain blocks and few character references, so their text can be cut out by patterns.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(body, '<br[^>]*>', ' ', 'g'), '</?(?:p|h[1-6]|ul|ol|li|div|blockquote)(?:\s[^>]*)?>') AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"')) AS parts FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM c)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10)))::BIGINT AS n_chars FROM d
"""


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    boilerplate: bool
    inside: int
    named: bool = False


@dataclass
class _Open:
    tag: str
    boilerplate: bool
    lasting: bool
    silent: bool
    region: bool
    inside: int
    last_region: int
    named: bool = False


def _names(value: str) -> set[str]:
    """Words of a class, id or role, but for those of tokens that name a state."""
    found: set[str] = set()
    for token in value.lower().split():
        words = set(re.split(r"[^a-z]+", token))
        if not words & STATES:
            found |= words
    return found


class _Lines(HTMLParser):
    """Blocks of a page as lines, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0
        #: Of each container its tag and the container around it; the page itself is the first.
        self.kinds: list[str] = [""]
        self.around: list[int] = [0]
        self.weak: set[int] = set()
        self.strong: set[int] = set()
        self.where: dict[str, list[int]] = {}

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            top = self.stack[-1] if self.stack else None
            self.lines.append(Line(text, self.tags, self.linked, bool(top and top.boilerplate), top.inside if top else 0, bool(top and top.named)))
            self.tags = self.linked = 0

    def marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """How an element's name or attributes make what is in it boilerplate, articles too: "always", "strong", "weak" or not."""
        if tag in BOILERPLATE - WRAPPERS:
            return "always"
        if tag in ("html", "body"):
            return ""
        strong, weak = (FOREIGN, frozenset()) if tag in REGIONS else (STRONG, MARKS - {"header"} if tag == "header" else MARKS)
        found = ""
        for name, value in attrs:
            words = _names(value) if name in ("class", "id", "role") and value else frozenset()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "always"
            if strong & words:
                found = "strong"
            elif weak & words and not found:
                found = "weak"
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in _CLOSES_P:
            self.close_implied({"p"}, {"article", "section", "div", "td", "th", "li", "table", "blockquote", "body", "aside", "nav", "footer", "form", "main"})
        if tag in _IMPLIED:
            self.close_implied(_IMPLIED[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        top = self.stack[-1] if self.stack else None
        region = tag in REGIONS
        inside = top.inside if top else 0
        if tag in CONTAINERS:
            self.kinds.append(tag)
            self.around.append(inside)
            inside = len(self.kinds) - 1
        how = self.marked(tag, attrs)
        lasting = how == "always" or how == "strong" and tag not in CONTAINERS or bool(top and top.lasting)
        wrapped = tag in WRAPPERS and not (tag == "header" and top and top.region) or bool(top and top.boilerplate and not (region and not top.region))
        if how in ("weak", "strong") and tag in CONTAINERS:
            (self.weak if how == "weak" else self.strong).add(inside)
        named = how == "weak" and tag not in CONTAINERS or bool(top and top.named and tag not in CONTAINERS)
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append(
            _Open(tag, lasting or wrapped, lasting, tag in SILENT or bool(top and top.silent and not (region or tag == "body")), region or bool(top and top.region), inside, len(self.stack) if region else top.last_region if top else -1, named)
        )
        if tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT - {"script", "style", "title", "textarea", "iframe"}:
            self.handle_endtag(tag)

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these."""
        return max((at[-1] for tag in tags if (at := self.where.get(tag))), default=-1)

    def close_implied(self, tags: set[str], stop: set[str]) -> None:
        if (at := self.last(tags)) > self.last(stop - tags):
            self.pop_to(at)

    def pop_to(self, i: int) -> None:
        for x in self.stack[i:]:
            self.where[x.tag].pop()
            self.links -= x.tag == "a"
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        at = self.last({tag})
        # what an article or main holds can't end what is around it, but for the page's own ends
        if at >= 0 and (at >= self.stack[-1].last_region or tag in ("html", "body", *REGIONS)):
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].silent:
            return
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the ends held."""
    r = math.ceil(2 * sigma)
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), mode="valid") if len(ratios) else ratios


def main_text(html: str, sigma: float = 1.0) -> str:
    """The lines of the content regions, joined by line ends; empty if there are none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    own = np.array([(len(x.text) - min(x.linked, len(x.text))) / max(1, x.tags) for x in lines], float)
    ratio = smoothed(own, sigma)
    linked = np.array([2 * x.linked > len(x.text) for x in lines])
    clean = np.array([not x.boilerplate for x in lines]) & ~linked
    if not clean.any():
        return ""
    # one threshold splits the ratios in two clusters: their spread, but no more than half their mean
    line = min(ratio.std(), ratio[clean].mean() / 2)
    high = clean & (ratio >= line)
    if not high.any():
        high = clean
    paragraph = own[high].mean() / 2
    left_out = np.array([x.named for x in lines]) & (own < paragraph)
    edges = np.flatnonzero(np.diff(np.r_[False, linked, False]))
    for begin, end in zip(edges[::2], edges[1::2], strict=True):  # runs of links, each as one
        left_out[begin:end] |= ratio[begin:end].min() < line
    around, kinds = parser.around, parser.kinds

    def summed(values: list[int]) -> list[int]:
        """The sum of values of lines inside each container."""
        total = [0] * len(kinds)
        for x, v in zip(lines, values, strict=True):
            total[x.inside] += v
        for n in range(len(kinds) - 1, 0, -1):
            total[around[n]] += total[n]
        return total

    told = summed([len(x.text) if h else 0 for x, h in zip(lines, high, strict=True)])
    without, under = told[0], [False] * len(kinds)
    for n in range(1, len(kinds)):
        under[n] = under[around[n]] or n in parser.strong
        if under[n] and not under[around[n]]:
            without -= told[n]
    kept_anyway = 5 * without < told[0]
    whole = told[0] if kept_anyway else without
    dropped = [False] * len(kinds)
    for n in range(1, len(kinds)):
        most = 2 * told[n] >= whole
        dropped[n] = dropped[around[n]] or n in parser.weak and not most or n in parser.strong and not (kept_anyway and most)
    out = [x.boilerplate or dropped[x.inside] or bool(left) for x, left in zip(lines, left_out, strict=True)]
    weight = summed([0 if o else len(x.text) if h else -len(x.text) for x, h, o in zip(lines, high, out, strict=True)])
    best = max(weight)
    named, above = [], [False] * len(kinds)
    for n in range(1, len(kinds)):
        above[n] = above[around[n]] or kinds[around[n]] in REGIONS
        if kinds[n] in REGIONS and weight[n] > 0 and not (above[n] and kinds[n] == "main"):
            named.append(n)
    outer = [n for n in named if not above[n]]
    if outer and 2 * sum(weight[n] for n in outer) >= best:
        most = max(weight[n] for n in named)
        chosen = {n for n in named if 4 * weight[n] >= most}
    else:
        chosen = {max(n for n in range(len(kinds)) if 10 * weight[n] >= 9 * best)}
    inside = [n in chosen for n in range(len(kinds))]
    for n in range(1, len(kinds)):
        inside[n] = inside[n] or inside[around[n]]
    return "\n".join(x.text for x, o in zip(lines, out, strict=True) if inside[x.inside] and not o)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Other columns are ignored. A null or empty html, and a page without content, give an
    empty text. Pages of any length are read whole. n_chars counts code points. Repeated rows are read each; null ids and urls pass
    through; an empty table gives none.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
