"""Documents: JSON lines, sitemaps, API pages, articles in HTML, Markdown files."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewarden.functions import keys, numbers, text
from tidewarden.storage import sized, written


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; a missing file has none, a bad line raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their number from 1, as a serial reader
    counts them, blank ones too.

    A large file is read in splits, as many tasks. Lines of a split are in order, and a first
    pass counts them: a row a split, whose sums before it are where its numbers start.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = written(splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "line-starts")
    starts = sized(starts, starts.count(), 300)
    return lines.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def tolerant_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows: file, line, value as a map; errors: file, line, the first 300 characters)."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "").select("file", "line", F.trim("value").alias("raw"))
    parsed = lines.withColumn("v", F.try_parse_json("raw"))
    bad = parsed.where("v is null").select("file", "line", F.substring("raw", 1, 300).alias("start"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    wrapped = F.when(is_object, F.col("raw")).otherwise(F.concat(F.lit('{"value":'), F.col("raw"), F.lit("}")))
    good = parsed.where("v is not null").select("file", "line", F.from_json(wrapped, "map<string,string>").alias("value"))
    return good, bad


def flatten(df: DataFrame) -> DataFrame:
    """Fields of nested structs as columns with dotted names."""

    def walk(kind: T.StructType, at: str) -> Iterator[Column]:
        for f in kind:
            path = f"{at}.{f.name}" if at else f.name
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path)

    return df.select(*walk(df.schema, ""))


def sitemap(spark: SparkSession, path: str, host: str, path_prefix: str) -> DataFrame:
    """(source_link, last_modified) of allowed entries, each link once: the first in the file
    wins; sorted by link."""
    schema = "loc string, lastmod string"
    rows = spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
    found = rows.select(
        F.trim("loc").alias("source_link"),
        numbers.utc_time(F.trim("lastmod")).alias("last_modified"),
        F.monotonically_increasing_id().alias("pos"),
    ).where(keys.allowed_url(F.trim("loc"), host, path_prefix))
    first = found.groupBy("source_link").agg(F.min_by("last_modified", "pos").alias("last_modified"))
    return first.orderBy("source_link")


#: A page of the disease news API.
PADI_ITEM = "struct<id:bigint,url:string,title:string,published_at:string,rssfeed:struct<source_category:string>>"
PADI_PAGE = f"count bigint, next string, previous string, results array<{PADI_ITEM}>"
PADI_DETAIL = (
    "id bigint, title string, source_title string, text string, description string,"
    " sentences array<struct<computed_text:string>>, url string, external_id string,"
    " source string, published_at string, country string, continent string, lang string,"
    " rssfeed struct<source_category:string,name:string>,"
    " machine_classification_labels array<struct<name_en:string,name:string,task:string>>"
)


def padi_url(base: str, today, days: int = 7, **fixed: str) -> str:
    """Address of the first page: fixed parameters and a look-back in days."""
    from datetime import timedelta
    from urllib.parse import urlencode

    return f"{base}?{urlencode({**fixed, 'published_after': (today - timedelta(days=days)).isoformat()})}"


def padi_pages(spark: SparkSession, path: str) -> DataFrame:
    """Articles of saved API pages; those without id or address go."""
    return padi_items(spark.read.schema(PADI_PAGE).option("multiLine", True).json(path))


def padi_items(pages: DataFrame) -> DataFrame:
    """Articles that pages list, each once."""
    items = pages.select(F.explode("results").alias("r")).select("r.*")
    return items.where("id is not null and url is not null").dropDuplicates(["id"]).select(
        F.lit("padi_web").alias("source_id"),
        F.col("url").alias("source_link"),
        "title",
        numbers.utc_time(F.col("published_at")).alias("last_modified"),
        F.col("rssfeed.source_category").alias("category"),
    )


def padi_articles(details: DataFrame, column: str = "body") -> DataFrame:
    """Articles of API detail objects in a text column."""
    d = details.select(*details.columns, F.from_json(column, PADI_DETAIL).alias("d"))
    sentences = F.array_join(F.transform("d.sentences", lambda s: s["computed_text"]), "\n\n")
    body = F.coalesce(text.blank_to_null(F.col("d.text")), F.nullif(sentences, F.lit("")))
    anchor = F.nullif(F.regexp_extract(F.coalesce("d.description", F.lit("")), r"(?is)<a[^>]*>(.*?)</a>", 1), F.lit(""))
    labels = F.array_distinct(
        F.filter(F.transform("d.machine_classification_labels", lambda x: F.coalesce(x["name_en"], x["name"])), lambda x: x.isNotNull())
    )
    return d.select(
        *details.columns,
        numbers.first_known(
            F.col("d.title"), F.col("d.source_title"), anchor, F.get(F.split(F.coalesce("d.text", F.lit("")), "\n"), F.lit(0))
        ).alias("title"),
        F.coalesce(F.col("d.url"), F.col("d.external_id")).alias("source_link"),
        body.alias("fulltext"),
        labels.alias("keywords"),
        F.to_date(numbers.utc_time(F.col("d.published_at"))).alias("publication_date"),
        F.col("d.country").alias("country"),
        F.col("d.lang").alias("language"),
    )


class PagedSource(DataSource):
    """Python data source ``paged_api``: follows ``next`` links of saved or served pages.

    The option ``pages`` names a folder with one JSON file a page, as there is no network
    here; a page is read once even if a link repeats, up to ``limit`` items.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "id bigint, url string, title string, published_at string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options.get("pages", "")
        self.first = options.get("first", "page1.json")
        self.limit = int(options.get("limit", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.first)]  # each page names the next

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json
        import os

        name, seen, n = partition.value, set(), 0
        while name and name not in seen:
            seen.add(name)
            with open(os.path.join(self.folder, os.path.basename(name)), encoding="utf-8") as f:
                page = json.load(f)
            for r in page.get("results") or []:
                if not isinstance(r, dict) or r.get("id") is None or not r.get("url"):
                    continue
                yield r["id"], r["url"], r.get("title"), r.get("published_at")
                n += 1
                if self.limit and n >= self.limit:
                    return
            name = page.get("next")


class ArticleParser(HTMLParser):
    """Title, meta fields and body blocks of an article page."""

    BLOCKS = {"p": "", "h2": "## ", "h3": "### "}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.fields: dict[str, list[str]] = {}
        self.blocks: list[str] = []
        self.open: list[tuple[str, str | None]] = []
        self.buffer: list[str] | None = None
        self.prefix = ""

    def _inside(self, name: str) -> bool:
        return any(n == name for _, n in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta":
            key = a.get("name") or a.get("property")
            if key:
                self.meta.setdefault(key, a.get("content") or "")
            return
        if tag == "link":
            if a.get("rel") == "canonical":
                self.meta.setdefault("canonical", a.get("href") or "")
            return
        if tag in ("br", "img", "hr", "input"):
            return
        name = a.get("id") or a.get("class")
        self.open.append((tag, "h1" if tag == "h1" else "title" if tag == "title" else name))
        if tag in self.BLOCKS and self._inside("text"):
            self.buffer, self.prefix = [], self.BLOCKS[tag]
        elif tag in ("strong", "b") and self.buffer is not None:
            self.buffer.append("**")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("strong", "b") and self.buffer is not None:
            self.buffer.append("**")
        if tag in self.BLOCKS and self.buffer is not None:
            body = " ".join("".join(self.buffer).split())
            if body:
                self.blocks.append(self.prefix + body)
            self.buffer = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.buffer is not None:
            self.buffer.append(data)
        for name in ("title", "h1", "date", "category", "author"):
            if self._inside(name):
                self.fields.setdefault(name, []).append(data)

    def value(self, name: str) -> str | None:
        joined = " ".join(" ".join(self.fields.get(name, [])).split())
        return joined or None


#: Where the parser decodes no references, or an ampersand with the closed reference that it may start.
_AMPERSAND = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?(?:</\1|\Z)|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?")


def _closed_only(page: str) -> str:
    """``page`` with ampersands escaped that start no reference closed by a semicolon."""

    def one(found: re.Match) -> str:
        whole, name = found[0], found[2]
        if whole[0] == "<" or name and (name[0] == "#" or name in html5):
            return whole
        return f"&amp;{name or ''}"

    return _AMPERSAND.sub(one, page)


ARTICLE_SCHEMA = (
    "source_link string, title string, description string, keywords array<string>, category string,"
    " author string, date_text string, canonical_url string, image_url string, fulltext string, error string"
)


def articles(pages: DataFrame, link: str = "source_link", body: str = "html", closed_only: bool = False) -> DataFrame:
    """Article fields of HTML pages; a page without a title gives a row with ``error``.

    As browsers do, ``&amp`` is read as ``&amp;``; with ``closed_only`` a character reference
    without its semicolon, as of a title cut short, stays as it is written.
    """

    def one(source_link: str, page: str | None) -> dict:
        try:
            parser = ArticleParser()
            parser.feed(_closed_only(page or "") if closed_only else page or "")
            title = parser.value("h1") or parser.value("title")
            if not title:
                raise ValueError("page has no title")
            words = [w.strip() for w in parser.meta.get("keywords", "").split(",")]
            return {
                "source_link": source_link,
                "title": title,
                "description": parser.meta.get("description") or None,
                "keywords": [w for w in words if w],
                "category": parser.value("category"),
                "author": parser.value("author"),
                "date_text": parser.value("date"),
                "canonical_url": parser.meta.get("canonical") or None,
                "image_url": parser.meta.get("og:image") or None,
                "fulltext": "\n\n".join([f"# {title}", *parser.blocks]),
                "error": None,
            }
        except Exception as problem:  # one bad page becomes a dead letter
            return {"source_link": source_link, "keywords": [], "error": f"{type(problem).__name__}: {problem}"}

    fields = (f.strip().split(" ") for f in ARTICLE_SCHEMA.split(","))
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(link).to_pylist(), batch.column(body).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([one(a, b) for a, b in pairs], schema)

    return pages.select(link, body).mapInArrow(run, ARTICLE_SCHEMA)


def plain_text(c: Column) -> Column:
    """Text of an HTML fragment: tags out, entities decoded, white space collapsed."""

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(html.unescape(v).split()))

    return decode(F.regexp_replace(c, "(?s)<[^>]*>", " "))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): Markdown or other text files, a row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def pdf_files(spark: SparkSession, path: str, least: int = 5000) -> DataFrame:
    """(path, content): files of more than ``least`` bytes that start as a PDF does."""
    files = spark.read.format("binaryFile").load(path)
    return files.where((F.col("length") > least) & F.startswith("content", F.lit(b"%PDF-"))).select("path", "content")


def nested_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def german_publication(c: Column) -> Column:
    return numbers.german_date(c)
