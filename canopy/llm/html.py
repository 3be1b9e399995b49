"""Main text of web pages.

The standard library's parser streams events; each block of text is a line with its length and the tags met since the
line before. The text-to-tag ratios, smoothed by a Gaussian, fall into two clusters, and the dense one points at
the content region: the articles (or, failing those, the smallest element) that hold it. Everything of the region is
kept but navigation, headers, footers, asides, forms, adverts, notices and comments.

Names are only hints: an element that its tag, role, class or id marks as one of those is left out, unless too little
dense text would remain without it. Then the marked element with most dense text counts as unmarked, and so on; so an
article of class "tag-ad", a wrapper of class "no-sidebar" or a form around a whole page keep their text.

Elements are numbered as they open and know their parent, so time and memory grow with the page, however deep it nests.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
SKIP = frozenset(
    "audio button canvas datalist head iframe input label legend map noscript object optgroup option script select style svg template textarea title "
    "video".split()
)
#: Elements that hold it only if nothing else does, and elements that are merely marked.
APART, MARKED = frozenset("aside dialog footer menu nav".split()), frozenset({"form", "fieldset"})
#: Elements that can be a content region.
REGIONS = frozenset("article body center div fieldset html main section table tbody td".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class and id names that mark what isn't article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog "
    "footer masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related reply "
    "replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: A start tag of these ends an open paragraph.
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Marks of what may be longer than the article: it is kept only if nothing else is dense.
READERS = frozenset("comment comments commentlist disqus footer masthead menu nav navbar navigation reply replies respond sidebar sidebars".split())
#: Marked elements are left out if this share of the dense text remains; those of READERS if this share of all text does.
ENOUGH, FEW = 0.2, 0.02
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Lines(HTMLParser):
    """Lines of a page: text, tags before it, whether it is skipped, its element. Element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[int] = []
        self.open: Counter = Counter()  # of each tag
        self.tag, self.parent = ["html"], [0]
        #: For each element: 1 if it is skipped, 1 to 3 if it is marked (2 by READERS, 3 by APART), the outermost article around it.
        self.skip, self.mark, self.article = [0], [0], [0]
        self.tags = 0
        self.text: list[str] = []
        self.lines: list[tuple[str, int, int, int]] = []

    def _kind(self, tag: str, attrs: list, inside: bool) -> tuple[int, int]:
        """Whether an element is skipped, and how it is marked."""
        if tag in SKIP:
            return 1, 0
        if tag in APART or tag == "header" and not inside:
            return 0, 3
        mark = int(tag in MARKED)
        for name, value in attrs if tag not in ("html", "body", "main") else ():
            if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true":
                return 1, 0
            if name == "role" and (value or "").lower() in ROLES:
                mark = max(mark, 1 + ((value or "").lower() not in ("form", "alert", "search")))
            if name in ("class", "id") and value:
                words = set(_SPLIT.split(_CAMEL.sub("-", value).lower()))
                mark = max(mark, 2 * (not READERS.isdisjoint(words)), int(not MARKS.isdisjoint(words)), int("header" in words and not inside))
        return 0, mark

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                at = self.stack[-1] if self.stack else 0
                self.lines.append((text, self.tags, self.skip[at], at))
                self.tags = 0
            self.text = []

    def _pop(self, k: int) -> None:
        self.open.subtract(self.tag[n] for n in self.stack[k:])
        del self.stack[k:]

    def _close(self, tags: set[str], within: frozenset = frozenset({"table", "ul", "ol", "dl"})) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                self._pop(k)
                return
            if tag in within or tag in BLOCKS and "p" in tags:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inside = bool(self.stack) and self.article[self.stack[-1]] > 0
        skip, mark = self._kind(tag, attrs, inside)
        if tag in BLOCKS or skip or mark:
            self.end_line()  # a tag that ends a line counts for the next one
            if tag in CLOSES_P:
                self._close({"p"})
            if tag in SAME:
                self._close(SAME[tag])
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        up, number = self.stack[-1] if self.stack else 0, len(self.tag)
        role = next((v for k, v in attrs if k == "role"), None)
        article = tag in ("article", "main") or role in ("article", "main") or any(k == "itemprop" and v == "articleBody" for k, v in attrs)
        self.tag.append(tag)
        self.parent.append(up)
        self.skip.append(self.skip[up] or skip)
        self.mark.append(mark)
        self.article.append(self.article[up] or number * article)
        self.stack.append(number)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            self.tags += 1
            return
        for k in range(len(self.stack) - 1, -1, -1):
            here = self.tag[self.stack[k]]
            if here == tag:
                if tag in BLOCKS or any(self.tag[n] in BLOCKS or self.skip[n] or self.mark[n] for n in self.stack[k:]):
                    self.end_line()
                self._pop(k)
                break
            if tag not in BLOCKS and here in BLOCKS:
                break  # an inline end tag doesn't reach beyond its block
        self.tags += 1

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def _left_out(page: _Lines, weight: list[int], text: list[int]) -> list[bool]:
    """For each element whether a marked element around it is left out; weight: the dense text directly in each, text: all."""
    n = len(page.tag)
    around = [0] * n  # the nearest marked element, itself included
    for i in range(1, n):
        around[i] = i if page.mark[i] else around[page.parent[i]]
    own = [0] * n  # dense text whose nearest marked element it is; 0: of none
    for i in range(n):
        own[around[i]] += weight[i]
    total, sums, below = sum(weight), own[:], [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        if page.mark[i]:
            up = around[page.parent[i]]
            sums[up] += sums[i] if up else 0
            below[up].append(i)
    free, void = own[0], set()
    loose, every = sum(t for t, a in zip(text, around, strict=True) if not a), sum(text)
    queue = [(page.mark[i], -sums[i], i) for i in below[0]]  # what is least surely apart comes first
    heapq.heapify(queue)
    while queue and free < ENOUGH * total:
        _, heaviest, i = heapq.heappop(queue)
        if not heaviest or page.mark[i] == 3 and loose or page.mark[i] == 2 and loose >= FEW * every:
            continue
        void.add(i)
        free, loose = free + own[i], loose + own[i]
        for j in below[i]:
            heapq.heappush(queue, (page.mark[j], -sums[j], j))
    out = [False] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] or page.mark[i] > 0 and i not in void
    return out


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def dense(ratios: np.ndarray) -> np.ndarray:
    """The lines of the upper of two clusters, by the threshold between their means."""
    low, high = float(ratios.min()), float(ratios.max())
    if high <= 2 * low or len(ratios) < 3:
        return np.ones(len(ratios), bool)
    for _ in range(50):
        cut = (low + high) / 2
        parts = ratios[ratios < cut].mean(), ratios[ratios >= cut].mean()
        if parts == (low, high):
            break
        low, high = parts
    return ratios >= (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page, a block a line; empty for a null or empty page and for one without text."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if all(x[2] for x in page.lines):
        return ""
    ratios = np.array([0.0 if skip else len(text) / (1 + tags) for text, tags, skip, _ in page.lines])
    marked = dense(smooth(ratios, sigma)).tolist()
    weight, sizes = [0] * len(page.tag), [0] * len(page.tag)
    for (text, _, skip, at), m in zip(page.lines, marked, strict=True):
        sizes[at] += 0 if skip else len(text)
        weight[at] += len(text) if m and not skip else 0
    out = _left_out(page, weight, sizes)
    lines = [(x, m) for x, m in zip(page.lines, marked, strict=True) if not x[2] and not out[x[3]]]
    content = [x for x, m in lines if m] or [x for x, _ in lines]
    articles = {page.article[x[3]] for x in content} - {0}
    if articles:
        return "\n".join(x[0] for x, _ in lines if page.article[x[3]] in articles)
    held = [0] * len(page.tag)
    for x in content:
        held[x[3]] += 1
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    region = max((i for i, n in enumerate(held) if n == len(content)), default=0)
    while region and page.tag[region] not in REGIONS:
        region = page.parent[region]
    within = [i == region for i in range(len(held))]
    for i in range(1, len(within)):
        within[i] = within[i] or within[page.parent[i]]
    return "\n".join(x[0] for x, _ in lines if within[x[3]])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row, from the whole page.

    A null or empty page gives an empty text of 0 characters; repeated rows, null ids and null urls stay; an empty
    table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
