"""Lists: sorting, paging, options, numbering, views of cases and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.functions import text

#: Labels and codes, fixed values.
RELEVANCE_DE = (("low", "niedrig"), ("medium", "mittel"), ("high", "hoch"))
POPULATION_CODES = (
    ("wild birds", "wild"),
    ("wild", "wild"),
    ("captive", "captive"),
    ("captive wild", "captive"),
    ("poultry", "poultry"),
)


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str) -> DataFrame:
    """Rows by (column, descending) keys, nulls last either way, ties by a unique column."""
    order = [
        F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys
    ]
    return df.orderBy(*order, F.col(tie).asc_nulls_last())


def sort_reports(df: DataFrame) -> DataFrame:
    """By score, null as -1, then date, null as blank, both descending."""
    return df.orderBy(
        F.coalesce("score", F.lit(-1)).desc(),
        F.coalesce(F.col("report_date").cast("string"), F.lit("")).desc(),
        F.col("report_id"),
    )


def page(df: DataFrame, number: int, size: int = 100, rows: int | None = None) -> DataFrame:
    """Page ``number`` from 1 of a sorted table; with its count of rows, clamped to the last."""
    if rows is not None:
        number = min(number, max(1, -(-rows // size)))
    return df.offset((max(1, number) - 1) * size).limit(size)


def numbered(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Rows with their number from 1, in a total order.

    Numbers come from per-range counts: rows are dealt by ranges of the order and numbered
    there, so no task sees all of them. The ranges are kept (spilling to disk), as they are
    read twice and, drawn from a sample, would fall elsewhere the second time.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).persist()
    within = ranged.withColumn(
        "__n", F.row_number().over(W.partitionBy("__part").orderBy(*order))
    )
    counts = within.groupBy("__part").agg(F.count("*").alias("__size"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    return (
        within.join(F.broadcast(starts.drop("__size")), "__part")
        .withColumn(name, F.col("__n") + F.col("__start"))
        .drop("__part", "__n", "__start")
    )


def options(df: DataFrame, column: str, collation: str | None = None) -> DataFrame:
    """Distinct known values, sorted, by a language's order if one is named."""
    out = df.where(F.col(column).isNotNull()).select(column).distinct()
    order = F.collate(F.col(column), collation) if collation else F.col(column)
    return out.orderBy(order)


def mapped(c: Column, table: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """A label by a lower-case lookup; the default where there is none."""
    out = F.coalesce(*(F.when(F.lower(c) == k, F.lit(v)) for k, v in table), F.lit(None))
    return out if default is None else F.coalesce(out, default)


def population_code(c: Column) -> Column:
    return mapped(c, POPULATION_CODES, F.lower(c))


def relevance_label(c: Column) -> Column:
    return mapped(c, RELEVANCE_DE)


def population(wildlife: Column, production: Column, unit: Column) -> Column:
    """Wild, captive, poultry or apiary from three fields of a notification."""
    kind = F.lower(text.collapse_space(wildlife))
    return (
        F.when(kind == "wild", "wild")
        .when(kind.isin("captive", "captive wild"), "captive")
        .when(F.coalesce(F.trim(production), F.lit("")) != "", "poultry")
        .when(F.lower(F.trim(unit)) == "apiary", "apiary")
    )


def place(*names: Column) -> Column:
    """The first known of some names of a place."""
    return F.coalesce(*(text.blank_to_null(n) for n in names))


def case_view(events: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Events as cases: IRIs, codes, display times."""
    table = tuple((k.lower(), v) for k, v in aliases.items())
    return events.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("case_id"),
        mapped(F.col("disease"), table, F.col("disease")).alias("disease"),
        population_code(F.col("population")).alias("population"),
        F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm").alias("reported_at"),
        "lat",
        "lon",
        place(F.col("admin2"), F.col("admin1"), F.col("country")).alias("location"),
    )


def geojson(cases: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(feature): a GeoJSON feature of each located case, a row each."""
    located = cases.where("lat is not null and lon is not null")
    geometry = F.struct(
        F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
    ).alias("geometry")
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry, F.struct(*properties).alias("properties")
    )
    return located.select(F.to_json(feature).alias("feature"))
