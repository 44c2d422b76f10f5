"""HTML extraction by nearest-URL page differencing.

Every page becomes text lines: block elements end a line, and a line knows whether it stands inside an
article element, outside of it, or in page chrome (navigation, footer, aside, form, adverts, notices,
comments), which is never main text. An article or main element below a form, a wrapper that only its class names make chrome, or a chrome
element that is never closed is an article all the same; below closed chrome elements (a teaser in a sidebar, a reader's comment) it is not.
Class names count by whole words of the element itself: inside an article only names made of nothing but chrome words, never on
the text elements, and not after words like "has" or "no". A section of main that opens with a heading "Comments" is the readers'.
Pages of a host are ordered by URL path and each is paired with the
nearest page before and after it whose lines are others; the lines of a pair are aligned by longest common
subsequence, and shared lines are deleted. Where a page marks its article, all its lines are aligned, but a shared line of the
article is deleted only as part of the template: both neighbours have it in their chrome, next to another line that is
shared. What only one has there may be a quotation or a link to this page, and two editions of one article share true text, of
which the contract drops nothing. Without an article differencing decides for all lines.

Scale: pages are range-partitioned by (host, path, page_id), so a host with a third of all pages is spread
over many tasks and pairs are neighbours inside a partition; the shuffle carries lines, not markup.
A page at a partition's edge has one neighbour.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, table

BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DEAD = set("head script style noscript template button select option textarea iframe svg canvas object".split())
CHROME = set("nav footer aside form dialog menu".split())
NOTHING, CHROME_LINE, OUTSIDE, ARTICLE = range(4)  # what the text of an element is
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote em strong b i a code figcaption".split())  # text elements: class names say nothing
NOISE = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice popup modal overlay newsletter subscribe sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies share social related recommended widget pagination skip copyright".split()
)
NEUTRAL = set("site page main top bottom left right area list box bar wrap wrapper container block section slot unit link links post posts article articles item items inner outer signup form row col column buttons icons header content text".split())
NEGATED = set("has with no without is not".split())
_COMMENTS = re.compile(r"(\d+ )?((readers?'?s?|user) )?comments?( ?\(?\d+\)?)?:?|leave a (comment|reply)|join the (discussion|conversation)", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")


@lru_cache(1 << 16)
def noise(names: str, strict: bool) -> bool:
    """Whether class names make an element chrome: a name with a chrome word, not negated; if strict, of no other than chrome and neutral words."""
    for name in names.lower().split():
        words = [w for w in _PARTS.split(re.sub(r"skip-?link", "skip", name)) if w]
        if words and not NOISE.isdisjoint(words) and NEGATED.isdisjoint(words) and (not strict or all(w in NOISE or w in NEUTRAL for w in words)):
            return True
    return False


class _Element:
    """An open element: its kind, the chrome that may be undone below it, and whether it was closed."""

    __slots__ = ("closed", "kind", "tag", "under")

    def __init__(self, tag: str, kind: int, under: tuple):
        self.tag, self.kind, self.under, self.closed = tag, kind, under, False


class _Lines(HTMLParser):
    """Lines as (text, kind, chrome elements above an article, if any)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.open: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.lines: list[tuple[str, int, tuple]] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.buffer)).strip()
        self.buffer = []
        if text:
            top = self.stack[-1] if self.stack else None
            self.lines.append((text, top.kind if top else OUTSIDE, top.under if top and top.kind == ARTICLE else ()))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag == "p":
            self._close("p", within="p")
        elif tag == "li":
            self._close("li", within="ul ol li")
        top = self.stack[-1] if self.stack else None
        kind, under = (top.kind, top.under) if top else (OUTSIDE, ())
        mine = None
        if kind != NOTHING:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in (v or "").replace(" ", "").lower()) for k, v in attrs)
            marks = tag in ("article", "main")
            if hidden:
                kind = NOTHING
            elif kind == CHROME_LINE:
                if marks and not noise(names, True):
                    kind = ARTICLE
                mine = (tag in CHROME and tag != "form") or "comment" in names.lower()
            elif tag in CHROME or (tag == "header" and kind == OUTSIDE):
                kind, mine = CHROME_LINE, tag != "form"
            elif marks:
                kind = CHROME_LINE if kind == ARTICLE and noise(names, True) else ARTICLE
            elif tag not in ("html", "body") and names and (tag not in PLAIN or kind != ARTICLE) and noise(names, kind == ARTICLE or tag in PLAIN):
                kind, mine = CHROME_LINE, "comment" in names.lower()
        if tag in DEAD:
            kind = NOTHING
        element = _Element(tag, kind, under)
        if mine:  # an article below it is one only if this is never closed
            element.under = (*under, element)
        self.stack.append(element)
        self.open[tag] += 1

    def _cut(self, i: int, closed: bool) -> None:
        for element in self.stack[i:]:
            self.open[element.tag] -= 1
        self.stack[i].closed = closed
        del self.stack[i:]

    def _close(self, tag: str, within: str) -> None:
        """An open paragraph or list item ends where the next begins."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].tag
            if name == tag:
                self._cut(i, True)
                return
            if name in BLOCK and name not in within.split():
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            before = len(self.lines)
            self.flush()
            if tag in ("h2", "h3", "h4", "h5", "h6") and len(self.lines) > before and _COMMENTS.fullmatch(self.lines[-1][0]):
                self._comments()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._cut(i, True)
                return

    def _comments(self) -> None:
        """The readers' comments begin here: what is left of the section or main around the heading is theirs, outside of an article element."""
        if self.open["article"]:
            return
        around = [e for e in self.stack if e.tag in ("section", "div", "main")]
        if around and around[-1].kind in (ARTICLE, OUTSIDE):
            self.lines[-1] = (self.lines[-1][0], CHROME_LINE, ())
            for e in self.stack[self.stack.index(around[-1]) :]:
                e.kind = CHROME_LINE

    def handle_data(self, data):
        if not self.stack or self.stack[-1].kind != NOTHING:
            self.buffer.append(data)


def page_lines(markup: str) -> list[tuple[str, int]]:
    """(text, kind) of a page's lines."""
    parser = _Lines()
    parser.feed(markup)
    parser.close()
    parser.flush()
    return [(text, CHROME_LINE if any(e.closed for e in under) else kind) for text, kind, under in parser.lines]


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in a and in b of one longest common subsequence.

    Equal ends are set aside; between them a row of the table is one long integer of bits, so 10,000 by 10,000 lines take a second's fraction.
    Every `step`-th row is kept and those between are computed again on the way back, so memory grows with the root of the rows.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    left, right = set(range(lo)) | set(range(len(a) - end, len(a))), set(range(lo)) | set(range(len(b) - end, len(b)))
    both = set(a[lo : len(a) - end]) & set(b[lo : len(b) - end])
    x = [i for i in range(lo, len(a) - end) if a[i] in both]
    y = [j for j in range(lo, len(b) - end) if b[j] in both]
    if not x or not y:
        return left, right
    where: dict[str, int] = {}
    for place, i in enumerate(x):
        where[a[i]] = where.get(a[i], 0) | 1 << place
    full = (1 << len(x)) - 1

    def rows(start: int, begin: int, stop: int) -> list[int]:
        """Rows begin + 1 to stop after the row `start`; a 0 bit is a place of x at which the common length grows."""
        out, row = [], start
        for j in y[begin:stop]:
            u = row & where[b[j]]
            row = ((row + u) | (row - u)) & full
            out.append(row)
        return out

    step = max(1, int(len(y) ** 0.5))
    kept, row = [full], full
    for begin in range(0, len(y), step):
        row = rows(row, begin, min(begin + step, len(y)))[-1]
        kept.append(row)
    i, j, part, held = len(x), len(y), -1, []
    while i and j:
        if (j - 1) // step != part:
            part = (j - 1) // step
            held = [kept[part], *rows(kept[part], part * step, min((part + 1) * step, len(y)))]
        k = j - part * step
        if held[k] >> (i - 1) & 1:
            i -= 1
        elif not held[k - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            left.add(x[i])
            right.add(y[j])
    return left, right


def main_text(lines: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    """Lines that stay after differencing against the neighbours' lines."""
    marked = any(kind == ARTICLE for _, kind in lines)
    found: list[set[int]] = []
    for other in neighbours:
        theirs = other if marked else [x for x in other if x[1] != ARTICLE]
        left, right = common_lines([t for t, _ in lines], [t for t, _ in theirs])
        if marked:
            pairs = set(zip(sorted(left), sorted(right), strict=True))
            left = {i for i, j in pairs if theirs[j][1] == CHROME_LINE and not pairs.isdisjoint({(i - 1, j - 1), (i + 1, j + 1)})}
        found.append(left)
    if marked:
        shared = set.intersection(*found) if len(found) > 1 else set()
    else:
        shared = set().union(*found)
    stay = [i for i, (_, kind) in enumerate(lines) if i not in shared and kind == (ARTICLE if marked else OUTSIDE)]
    return "\n".join(lines[i][0] for i in stay)


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) by which pages are ordered; a null or broken URL has neither."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", ""


def extract(pages: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null html gives the empty text; null URLs form a host of their own that is never paired. Repeated
    rows each get a row, and equal pages are not compared with each other. Other columns are ignored.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [page_lines(h or "") for h in part.column("html").to_pylist()]
                keys = [url_key(u) for u in part.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())), pa.array([[k for _, k in x] for x in found], pa.list_(pa.int8()))],
                    names=["page_id", "url", "host", "path", "lines", "kinds"],
                )

    def packed(out: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        run: list[tuple] = []  # pages in a row with equal lines; their markup is held once
        host, lines, before = "", [], None

        def close(after) -> None:
            text = main_text(lines, [x for x in (before, after) if x is not None and host])
            out.extend((page_id, url, text, len(text)) for page_id, url in run)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for page_id, url, host_, texts, kinds in zip(*(part[c] for c in ("page_id", "url", "host", "lines", "kinds")), strict=True):
                    here = list(zip(texts, kinds, strict=True))
                    if not here:
                        out.append((page_id, url, "", 0))
                    elif run and host_ == host and here == lines:
                        run.append((page_id, url))
                    else:
                        if run:
                            close(here if host_ == host else None)
                        before = lines if run and host_ == host else None
                        host, lines, run = host_, here, [(page_id, url)]
                if len(out) >= 512:
                    yield packed(out)
                    out.clear()
        if run:
            close(None)
        if out:
            yield packed(out)

    kind = pages.schema["page_id"].dataType.simpleString()
    id_type = to_arrow_type(pages.schema["page_id"].dataType)
    lines = pages.select("page_id", "url", "html").mapInArrow(parse, f"page_id {kind}, url string, host string, path string, lines array<string>, kinds array<tinyint>")
    n = n_partitions or partitions(pages.sparkSession)
    ordered = lines.repartitionByRange(n, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id", "url")
    return ordered.mapInArrow(difference, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


__all__ = ["common_lines", "extract", "main_text", "op8_html_main", "page_lines", "url_key"]
