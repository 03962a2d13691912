"""Main text of HTML pages by smoothed text-to-tag ratios.

The standard library's parser streams events; a line is the text between two block boundaries. Each line has
the ratio of its text (that of links left out) to its tags; lines in parts that HTML itself or their class, id or role names as
no article (menus, headers, footers, asides, adverts, notices, comments and the like) have ratio 0. The ratios are smoothed
with a Gaussian over the page, and a two-means threshold splits the lines into content and rest. The content lines,
weighed by their text, choose the region:

* of a page with article or main elements, the one that holds the most content (the innermost of equals);
* of any other page, the stretch from the first to the last content line of the deepest container with more than half of
  all content, and the headings and paragraphs that stand beside it, as far as they follow each other.

Inside the region all lines but those of the parts named above are kept, short ones too, so that nothing of the
article is dropped. Scripts, styles, templates, titles, form fields and embedded objects have no lines at all.

Elements are a tree of parent numbers and open tags are counted, so time and memory are linear in the page, however deep or
badly closed its markup is.

Defined results: null or empty html gives an empty text; repeated rows give equal rows; null ids and urls are
carried along; an empty table gives an empty result; other columns are ignored. Unclosed and truncated markup is read as
far as it goes.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import each, table

SIGMA = 1.5

# HTML's names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body div html main section table tbody td tr".split())
PROSE = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())
UNSHOWN = frozenset("audio button canvas embed form head iframe input noscript object script select style svg template textarea title video".split())
BESIDE = frozenset("aside dialog footer header menu nav".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words in a class or id that name what is not the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_WORDS = re.compile(r"[a-z0-9]+")


class Lines(HTMLParser):
    """Collects lines, and the tree of containers, from parser events.

    A line is (text, characters of links in it, tags, container, block tag, whether it stands in a part that is no article).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open blocks, each (tag, unshown, beside, container it opened or -1) with the inline tags open in it
        self.blocks: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        self.inline: list[list[tuple[str, bool, bool]]] = [[]]
        self.inline_open: list[Counter] = [Counter()]
        self.block_open: Counter = Counter()
        self.parents, self.articles = [-1], []
        self.at = 0  # the container
        self.unshown = self.beside = self.links = 0
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.lines: list[tuple[str, int, int, int, str, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, self.tags, self.at, self.blocks[-1][0], self.beside > 0))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.blocks[-1][0] == "p":  # a new paragraph ends an open one
            self.flush()
            self._pop_block()
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if not self.unshown:
            self.tags += 1
        if tag in VOID:
            return
        values = dict(attrs)
        unshown = tag in UNSHOWN or "hidden" in values
        names = _WORDS.findall(f"{values.get('class') or ''} {values.get('id') or ''}".lower()) if values else ()
        beside = tag in BESIDE or (tag not in ("article", "body", "html", "main") and (not NAMES.isdisjoint(names) or (values.get("role") or "").lower() in ROLES))
        self.unshown += unshown
        self.beside += beside
        if tag not in BLOCK:
            self.inline[-1].append((tag, unshown, beside))
            self.inline_open[-1][tag] += 1
            self.links += tag == "a"
            return
        number = -1
        if tag in CONTAINER:
            number = len(self.parents)
            self.parents.append(self.at)
            self.at = number
            if tag in ("article", "main") and not self.beside:
                self.articles.append(number)
        self.blocks.append((tag, unshown, beside, number))
        self.block_open[tag] += 1
        self.inline.append([])
        self.inline_open.append(Counter())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop_inline(self) -> str:
        tag, unshown, beside = self.inline[-1].pop()
        self.inline_open[-1][tag] -= 1
        self.unshown -= unshown
        self.beside -= beside
        self.links -= tag == "a"
        return tag

    def _pop_block(self) -> str:
        while self.inline[-1]:
            self._pop_inline()
        self.inline.pop()
        self.inline_open.pop()
        tag, unshown, beside, number = self.blocks.pop()
        self.block_open[tag] -= 1
        self.unshown -= unshown
        self.beside -= beside
        if number >= 0:
            self.at = self.parents[number]
        return tag

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if not self.unshown:
            self.tags += 1
        if tag in BLOCK:
            if self.block_open[tag]:
                while self._pop_block() != tag:
                    pass
        elif self.inline_open[-1][tag]:
            while self._pop_inline() != tag:
                pass

    def handle_data(self, data):
        if not self.unshown:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, mode="valid")


def threshold(values: np.ndarray) -> float:
    """Midpoint of two means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values >= cut
        if above.all():
            return low
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _inside(parents: list[int], region: int) -> np.ndarray:
    """Whether each container is the region or in it; parents come before their children."""
    out = np.zeros(len(parents), bool)
    out[region] = True
    for k in range(region + 1, len(parents)):
        out[k] = out[parents[k]]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    chars = np.array([max(0, len(text) - linked) for text, linked, *_ in lines], float)
    tags = np.array([n for _, _, n, *_ in lines], float)
    beside = np.array([b for *_, b in lines])
    values = smoothed(np.where(beside, 0, chars / (tags + 1)))
    content = (values >= threshold(values)) & ~beside
    held = np.zeros((2, len(parents)))  # of each container: characters of content, and of all lines
    where = np.array([k for *_, k, _, _ in lines])
    np.add.at(held[0], where, np.where(content, chars, 0))
    np.add.at(held[1], where, np.where(beside, 0, chars))
    for k in range(len(parents) - 1, 0, -1):
        held[:, parents[k]] += held[:, k]
    if parser.articles:
        region = max(parser.articles, key=lambda k: (held[0, k], held[1, k], k))
        chosen = _inside(parents, region)[where]
    else:
        region = int(np.flatnonzero(held[0] * 2 > held[0, 0])[-1]) if held[0, 0] else 0
        inside = _inside(parents, region)[where]
        own = np.flatnonzero(content & inside)
        if not len(own):
            return ""
        first, last = int(own[0]), int(own[-1])
        prose = [inside[k] and not beside[k] and lines[k][4] in PROSE and 2 * lines[k][1] <= len(lines[k][0]) for k in range(len(lines))]
        while first and prose[first - 1]:
            first -= 1
        while last + 1 < len(lines) and prose[last + 1]:
            last += 1
        chosen = inside & (np.arange(len(lines)) >= first) & (np.arange(len(lines)) <= last)
    return " ".join(line[0] for line, c, b in zip(lines, chosen, beside, strict=True) if c and not b)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in each(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


#: For pages whose article is the one element of that name, with p, h1, br and inline tags inside.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(
           regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1),
           '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t
  FROM pages),
b AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
           '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text
  FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
"""
