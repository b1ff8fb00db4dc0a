"""Parts of HTML pages as a table function: links, paragraphs and images, a row each.

``register`` makes it known to SQL, where it stands in a ``LATERAL`` join, so that pages are
parsed where they lie, in as many tasks as the table has partitions:

    SELECT page_id, part.* FROM pages, LATERAL page_parts(html) AS part
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

PARTS_SCHEMA = "kind string, n int, address string, text string"


class PartParser(HTMLParser):
    """(kind, n, address, text) of a page's parts, each kind numbered from 1 in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple] = []
        self.seen: dict[str, int] = {}
        self.open: dict[str, tuple[str | None, list[str]]] = {}
        self.silent = False

    def _add(self, kind: str, address: str | None, text: str | None) -> None:
        self.seen[kind] = self.seen.get(kind, 0) + 1
        self.parts.append((kind, self.seen[kind], address, text))

    def _close(self, tag: str) -> None:
        if tag in self.open:
            address, texts = self.open.pop(tag)
            text = re.sub(r"\s+", " ", "".join(texts)).strip()
            if address is not None or text:
                self._add("link" if tag == "a" else "paragraph", address, text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent = tag in ("script", "style")
        if tag in ("a", "p"):
            self._close(tag)  # neither holds its like
            self.open[tag] = (dict(attrs).get("href") if tag == "a" else None, [])
        elif tag == "img":
            values = dict(attrs)
            self._add("image", values.get("src"), values.get("alt"))

    def handle_endtag(self, tag: str) -> None:
        self.silent = False
        self._close(tag)
        if tag in ("article", "section", "div", "body"):
            self._close("p")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, texts in self.open.values():
                texts.append(data)

    def close(self) -> None:
        super().close()
        for tag in list(self.open):
            self._close(tag)


@udtf(returnType=PARTS_SCHEMA)
class PageParts:
    """Rows for one page; a null or empty page has none."""

    def eval(self, page: str) -> Iterator[tuple]:
        parser = PartParser()
        parser.feed(page or "")
        parser.close()
        yield from parser.parts


def register(spark: SparkSession, name: str = "page_parts") -> None:
    spark.udtf.register(name, PageParts)
