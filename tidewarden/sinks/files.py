"""Writers. All write folders of part files, as many as there are partitions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewarden.functions import text
from tidewarden.operators.listing import numbered

#: Columns of the frontend's report table, a fixed value.
FRONTEND_COLUMNS = (
    "id",
    "source",
    "title",
    "url",
    "teaser",
    "body",
    "report_date",
    "admin_level_1",
    "admin_level_2",
    "admin_level_3",
    "relevance_score",
    "relevance_score_string",
    "distance_km",
    "created_at",
    "updated_at",
)
#: The columns of a report that these come from; the rest are numbers, dates and blanks.
FRONTEND_SOURCES = {
    "source": "source_id",
    "title": "source_document_title",
    "url": "source_link",
    "teaser": "relevance_rationale",
    "body": "fulltext",
    "admin_level_1": "administrative_division_level_1",
    "admin_level_2": "administrative_division_level_2",
    "admin_level_3": "administrative_division_level_3",
    "relevance_score": "rule_relevance_score",
    "relevance_score_string": "relevance_level",
    "created_at": "source_retrieved_at",
    "updated_at": "source_retrieved_at",
}


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fields in alphabetical order, nulls kept, times in ISO form with microseconds."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    df.select(*sorted(df.columns)).write.mode(mode).options(**options).json(path)


def csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """The given columns as cells; those that the table lacks are blank."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [text.cell(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.mode(mode).options(header=True, emptyValue="", escape='"').csv(path)


def frontend_rows(reports: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Rows of the frontend's table as cells, numbered from 1 in the order of the records, or
    in that of some columns. What a report lacks is a blank cell."""
    kinds = {f.name: f.dataType for f in reports.schema}

    def cell(name):
        return text.cell(F.col(name), kinds[name]) if name in kinds else F.lit("")

    dates = [F.nullif(cell(c), F.lit("")) for c in ("source_publication_date", "confirmation_date")]
    cells = {
        **{name: cell(c) for name, c in FRONTEND_SOURCES.items()},
        "report_date": F.coalesce(*dates, F.lit("")),
        "distance_km": F.lit(""),
    }
    if order is None:
        reports, order = reports.withColumn("__order", F.monotonically_increasing_id()), ["__order"]
    rows = reports.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(order)), *(v.alias(k) for k, v in cells.items()))
    rows = numbered(rows, [f"__by{i}" for i in range(len(order))])
    return rows.withColumn("id", F.col("id").cast("string")).select(*FRONTEND_COLUMNS)


def frontend_path(path: str) -> str:
    """Where the frontend's rows of an export go: ``_mock_data_`` after the name's stem."""
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    name = f"{stem}_mock_data_.{ext}" if dot and stem else f"{name}_mock_data_"
    return f"{folder}/{name}" if folder else name


def n_triples(triples: DataFrame, path: str) -> None:
    """One line for each triple."""
    triples.dropDuplicates().select(statement(triples).alias("value")).write.mode("overwrite").text(path)


def turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> dict[str, int]:
    """Triples grouped by subject; each part file begins with the prefixes. Returns how many
    subjects and distinct triples were written."""
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in sorted(prefixes.items()))
    parts = triples.dropDuplicates().select("s", F.concat_ws(" ", "p", term(triples)).alias("po"))
    blocks = parts.groupBy("s").agg(F.sort_array(F.collect_set("po")).alias("pos"))
    seen = Observation()
    blocks = blocks.observe(seen, F.count("*").alias("subjects"), F.coalesce(F.sum(F.size("pos")), F.lit(0)).alias("triples"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
                first = False
            yield batch

    text_of = F.concat("s", F.lit(" "), F.array_join("pos", " ;\n    "), F.lit(" .")).alias("value")
    blocks.select(text_of).mapInArrow(headed, "value string").write.mode("overwrite").text(path)
    return seen.get


def term(triples: DataFrame | None = None) -> Column:
    """Object of a triple in Turtle; with its language if the table has one."""
    escaped = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    typed = F.when(F.col("datatype").isNull(), "").otherwise(F.concat(F.lit("^^"), F.col("datatype")))
    if triples is not None and "lang" in triples.columns:
        typed = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).otherwise(typed)
    return F.when(F.col("kind") != "literal", F.col("o")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), typed))


def statement(triples: DataFrame | None = None) -> Column:
    return F.concat_ws(" ", "s", "p", term(triples), F.lit("."))


def by_graph(triples: DataFrame, path: str) -> None:
    """A folder for each graph."""
    triples.dropDuplicates().write.mode("overwrite").partitionBy("graph").parquet(path)


def state(df: DataFrame, path: str) -> str:
    """Write a new version of a keyed state table beside the old, and return its path.

    Parquet has no update in place: readers keep the version that they opened, and the
    caller records which is current.
    """
    target = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return target


def raw_cache(pages: DataFrame, path: str) -> None:
    """(url, body, content_hash) of fetched pages."""
    pages.withColumn("content_hash", F.sha2("body", 256)).write.mode("append").parquet(path)


def report(one_row: DataFrame, title: str) -> tuple[str, str]:
    """(JSON, Markdown) of a one-row aggregate."""
    row = one_row.first().asDict(recursive=True)
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in row.items())]
    return json.dumps(row, sort_keys=True, default=str), "\n".join(lines) + "\n"


def jdbc(df: DataFrame, url: str, table: str, batch: int = 500) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch).mode("append").save()
