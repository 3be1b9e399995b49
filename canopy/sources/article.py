"""Web pages as Markdown-like sections: headings and paragraphs of the article, or of the body."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import markdown

OUT = frozenset("script style nav footer aside form noscript template select button title".split())
BREAK = frozenset("p div li ul ol section article main header table tr h1 h2 h3 h4 h5 h6 blockquote pre".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.heading, self.text, self.lines, self.article = 0, 0, [], [], 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append((bool(self.article), "#" * self.heading + " " * bool(self.heading) + line))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in OUT:
            self.flush()
            self.out += 1
        if tag in BREAK:
            self.flush()
            self.heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" else 0
            self.article += tag == "article"

    def handle_endtag(self, tag):
        if tag in BREAK or tag in OUT:
            if not self.out:
                self.flush()
            self.text, self.heading = [], 0
            self.article -= tag == "article" and self.article > 0
        self.out -= tag in OUT and self.out > 0

    def handle_data(self, data):
        if not self.out:
            self.text.append(data)


def to_markdown(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    inside = [line for article, line in reader.lines if article]
    return "\n".join(inside or [line for _, line in reader.lines])


def sections(pages: DataFrame, key: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(key, seq, level, heading, text) of each page; a first heading that repeats the title is skipped."""
    kinds = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url_col}` string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_markdown(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, url_col, "text"])

    made = pages.select(key, F.col(url_col).cast("string"), html_col).mapInArrow(run, kinds)
    return markdown.sections(made, key, title=T.url_title(F.col(url_col)))
