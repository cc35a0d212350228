"""Main text of web pages.

The standard library's parser streams a page's tags and texts. They become lines, one for each block of text, that know
how many tags they took and in which elements they lie. The ratio of text to tags of each line is smoothed with a
Gaussian over its neighbours and split into two clusters by a threshold; the lines of the upper cluster vote with their
characters for the element that holds the article, and the lines of that element are the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset(
    "head title script style noscript template nav header footer aside form menu search dialog iframe object embed svg canvas audio video "
    "select option button input textarea label datalist progress meter".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or id that mark such parts in elements without a meaning of their own.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification popup modal overlay newsletter subscribe subscription signup login sidebar side aside menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar footer foot masthead topbar pagination pager share sharing social related recommended widget "
    "comment comments commentlist disqus respond reply replies copyright".split()
)
HEADER_NAMES = frozenset("header head".split())
ARTICLE_NAMES = frozenset("article post entry story title content".split())
#: An opening tag ends an open element of the first set, unless one of the second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
_NAME = re.compile(r"[a-z0-9]+")
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*")


def outside(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form, script, style or the comments."""
    if tag in OUTSIDE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value and value.strip().lower() in OUTSIDE_ROLES:
            return True
        if key in ("class", "id") and value:
            for name in value.lower().split():
                words = set(_NAME.findall(name))
                if words & OUTSIDE_NAMES or words & HEADER_NAMES and not words & ARTICLE_NAMES:
                    return True
    return False


class Lines(HTMLParser):
    """The lines and elements of a page. nodes: (parent, tag, outside) of each element that holds lines, the page
    itself first; lines: (node, text, tags)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str, bool]] = [(-1, "", False)]
        self.lines: list[tuple[int, str, int]] = []
        self._open, self._text, self._tags = [0], [], 0
        self._dropping, self._muted = 0, 0  # open elements outside the article; those of them that are inline

    def _line(self) -> None:
        if text := " ".join("".join(self._text).split()):
            self.lines.append((self._open[-1], text, self._tags))
            self._tags = 0
        self._text = []

    def _pop(self, depth: int) -> None:
        closed = [self.nodes[node] for node in self._open[depth:]]
        if any(tag in BLOCKS for _, tag, _ in closed):
            self._line()
        self._dropping -= sum(out for _, _, out in closed)
        self._muted -= sum(out and tag not in BLOCKS for _, tag, out in closed)
        del self._open[depth:]

    def _find(self, tags, until=()) -> int:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.nodes[self._open[depth]][1]
            if tag in tags:
                return depth
            if tag in until:
                break
        return 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        block = tag in BLOCKS
        if block:
            self._line()
            if (depth := self._find({"p"}, BLOCKS - {"p"})) or tag in ENDS and (depth := self._find(*ENDS[tag])):
                self._pop(depth)
        if tag in VOID:
            return
        out = outside(tag, attrs)
        if block or out or self._dropping:
            self.nodes.append((self._open[-1], tag, out))
            self._open.append(len(self.nodes) - 1)
            self._dropping += out
            self._muted += out and not block

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in VOID:
            return
        if depth := self._find({tag}):
            self._pop(depth)
        elif tag in BLOCKS:
            self._line()

    def handle_data(self, data: str) -> None:
        if not self._muted:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        self._line()


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    """Each value with its neighbours, weighted by a Gaussian of the distance; the ends have fewer neighbours."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - reach), min(len(ratios), i + reach + 1))
        weights = [kernel[abs(i - j)] for j in near]
        out.append(sum(w * ratios[j] for w, j in zip(weights, near)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of two clusters of values, or the least value if the means are not twice apart."""
    low, high = min(values), max(values)
    for _ in range(32):
        middle = (low + high) / 2
        under, over = [v for v in values if v < middle], [v for v in values if v >= middle]
        new = (sum(under) / len(under) if under else low, sum(over) / len(over))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if 2 * low <= high else min(values)


def main_lines(nodes: list[tuple[int, str, bool]], lines: list[tuple[int, str, int]], sigma: float, share: float) -> list[str]:
    """The texts of the lines of the article."""
    dropped, within = [], []  # by node: whether it lies outside the article; the innermost article or main around it
    for parent, tag, out in nodes:
        up_dropped, up_within = (dropped[parent], within[parent]) if parent >= 0 else (0, -1)
        if tag in HEADINGS and up_dropped and nodes[up_dropped][1] == "header" and up_within >= 0:
            up_dropped = 0  # the article's own title
        me = len(dropped)
        within.append(me if tag in ("article", "main") and not up_dropped else up_within)
        dropped.append(up_dropped or (me if out else 0))
    kept = [i for i, (node, _, _) in enumerate(lines) if not dropped[node]]
    if not kept:
        return []
    ratios = smoothed([len(text) / max(tags, 1) for _, text, tags in lines], sigma)
    bound = threshold(ratios)
    votes = {i: len(lines[i][1]) for i in kept if ratios[i] >= bound}
    marked = [i for i in kept if within[lines[i][0]] >= 0]
    if marked:  # the page says where its article is
        kept, votes = marked, {i: n for i, n in votes.items() if within[lines[i][0]] >= 0}
    votes = votes or {i: len(lines[i][1]) for i in kept}
    held = [0] * len(nodes)
    for i, n in votes.items():
        node = lines[i][0]
        while node >= 0:
            held[node] += n
            node = nodes[node][0]
    total = held[0]
    articles = [n for n, (_, tag, _) in enumerate(nodes) if tag == "article" and 2 * held[n] > total]
    region = articles[-1] if articles else max((n for n in range(len(nodes)) if held[n] >= share * total and (n == 0 or nodes[n][1] not in HEADINGS | {"p", "li"})), default=0)

    def inside(node: int) -> bool:
        while node >= 0 and node != region:
            node = nodes[node][0]
        return node == region

    kept = [i for i in kept if inside(lines[i][0])]
    if not marked:  # only from the first to the last line of the upper cluster, with the headings before the first
        chosen = [i for i in kept if i in votes]
        first, last = kept.index(chosen[0]), kept.index(chosen[-1])
        while first and nodes[lines[kept[first - 1]][0]][1] in HEADINGS:
            first -= 1
        kept = kept[first : last + 1]
    return [lines[i][1] for i in kept]


def _complete(html: str) -> str:
    """The page without a comment or tag that it ends in."""
    comment = html.rfind("<!--")
    if comment >= 0 and html.find("-->", comment) < 0:
        html = html[:comment]
    tag = html.rfind("<")
    return html[:tag] if tag >= 0 and _CUT_TAG.fullmatch(html, tag) else html


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The article's blocks, joined by newlines; empty if there are none."""
    if not html:
        return ""
    page = Lines()
    page.feed(_complete(html))
    page.close()
    out = main_lines(page.nodes, page.lines, sigma, share)
    if not out:  # an element outside the article that was never closed may hold it
        around, nodes = set(), page.nodes
        for parent, tag, _ in nodes:
            while tag in ("article", "main") and parent >= 0:
                around.add(parent)
                parent = nodes[parent][0]
        if any(nodes[n][2] for n in around):
            out = main_lines([(p, t, o and n not in around) for n, (p, t, o) in enumerate(nodes)], page.lines, sigma, share)
    return "\n".join(out)


def extract_pages(pages: DataFrame, sigma: float = 1.0, share: float = 0.9) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html).

    text is the article's blocks in page order: character references decoded, white space inside a block turned into one
    space, blocks trimmed and joined by one newline. Null and empty pages, and pages without an article, have an empty
    text. Broken markup ends as a browser would end it. Each input row gives one row, repeated rows and null ids included;
    other columns are ignored; an empty table gives an empty one. No shuffle; a task holds one Arrow batch.

    sigma: width of the smoothing, in lines. share: the part of the upper cluster's characters that the innermost element
    taken for the article must hold where the page does not mark one.
    """
    ship(pages.sparkSession)
    keys = [c for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma, share) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(texts, pa.string())], names=[*keys, "text"])

    source = pages.select(*keys, F.col("html").cast("string").alias("html"))
    kinds = dict(source.dtypes)
    out = source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
