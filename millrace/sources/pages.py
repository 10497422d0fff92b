"""Links and visible text of HTML pages, as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SKIPPED = frozenset({"script", "style", "noscript", "template", "svg", "title"})
AREAS = frozenset({"header", "nav", "footer", "aside"})
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr td th table section article header footer nav aside br blockquote".split())
LINKS = "page_id long, position int, area string, target string, label string"


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.areas, self.skip = base, [], 0
        self.links: list[list] = []
        self.text: list[str] = []
        self.title, self.canonical = "", None
        self._open: list | None = None
        self._in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
            self._in_title = tag == "title"
        elif tag in AREAS:
            self.areas.append(tag)
        elif tag == "a" and values.get("href"):
            hidden = "display:none" in (values.get("style") or "").replace(" ", "") or "hidden" in values
            try:
                target = urljoin(self.base, values["href"])
            except ValueError:
                target = values["href"]
            self._open = [("hidden" if hidden else self.areas[-1] if self.areas else "body"), target, ""]
            self.links.append(self._open)
        elif tag == "link" and (values.get("rel") or "") == "canonical":
            self.canonical = values.get("href")
        if tag in BREAKS:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            self._in_title = False
        elif tag in AREAS and tag in self.areas:
            while self.areas.pop() != tag:
                pass
        elif tag == "a":
            self._open = None
        if tag in BREAKS:
            self.text.append("\n")

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self.skip:
            return
        self.text.append(data)
        if self._open is not None:
            self._open[2] += data


def _read(url: str | None, html: str | None) -> _Reader:
    reader = _Reader(url or "")
    reader.feed(html or "")
    reader.close()
    return reader


def batches_of(schema: StructType, rows: Iterator[tuple], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that texts are never copied by the batch."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def page_links(pages: DataFrame) -> DataFrame:
    """A row for each link of each page (page_id, url, html): its place, area, absolute target and label."""
    schema = StructType.fromDDL(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = (
            (page, i, area, target, " ".join(label.split()))
            for page, url, html in rows_of(batches)
            for i, (area, target, label) in enumerate(_read(url, html).links)
        )
        yield from batches_of(schema, links)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def page_text(pages: DataFrame) -> DataFrame:
    """Title, canonical address and visible text of each page, an empty line nowhere."""
    schema = StructType.fromDDL("page_id long, title string, canonical string, text string")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for page, url, html in rows_of(batches):
            r = _read(url, html)
            lines = (" ".join(x.split()) for x in "".join(r.text).split("\n"))
            yield page, " ".join(r.title.split()), r.canonical, "\n".join(x for x in lines if x)

    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: batches_of(schema, texts(batches)), schema)
