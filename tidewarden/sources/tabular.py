"""Tables of notifications from CSV files, and imports of report tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import numbers, text

#: Columns of an ADIS extract, a fixed value.
ADIS_COLUMNS = (
    "Reference",
    "National reference",
    "Country/Territory",
    "Typ",
    "Disease name",
    "Disease type",
    "Epidemiological unit",
    "Submitted on",
    "Modified on",
    "Administrative division level 1",
    "Administrative division level 2",
    "Administrative division level 3",
    "Outbreak occurring inside an already restricted zone",
    "Latitude",
    "Longitude",
    "Approximate location",
    "Location",
    "Wildlife type 1",
    "Production Type 1",
    "Water type 1",
    "Production system 1",
    "Measuring unit 1",
    "Susceptible 1",
    "Cases 1",
    "Dead 1",
    "Killed 1",
    "Slaughtered 1",
    "Vaccinated 1",
    "Outbreak year",
    "Suspicion/Start date",
    "Confirmation date",
    "End date",
    "Status Continuing/Resolved",
    "Suspicion",
    "Clinical signs",
    "Diagnostic tests",
    "Necropsy",
    "Category 1",
    "Subcategory 1",
    "Test name 1",
    "Test type 1",
    "Laboratory type 1",
    "Species 1",
    "Result date 1",
    "Result type 1",
    "Pertinence",
)
NA_MARKERS = ("", "NaN", "nan", "N/A", "NA", "null", "NULL", "None", "n/a")
DATES = ("Submitted on", "Modified on", "Suspicion/Start date", "Confirmation date", "End date", "Result date 1")
NUMBERS = ("Susceptible 1", "Cases 1", "Dead 1", "Killed 1", "Slaughtered 1", "Vaccinated 1", "Outbreak year")
FLAGS = (
    "Outbreak occurring inside an already restricted zone",
    "Approximate location",
    "Suspicion",
    "Clinical signs",
    "Diagnostic tests",
    "Necropsy",
)


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def first_existing(paths: Iterable[str]) -> str:
    """The first of some local paths that exists."""
    tried = list(paths)
    for p in tried:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(f"none of {tried} exists")


def csv(spark: SparkSession, path: str, names: Sequence[str] | None = None, sep: str = ";") -> DataFrame:
    """Every column as text; the reader drops a byte order mark."""
    reader = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(strings(names)) if names else reader).csv(path)


def adis(spark: SparkSession, path: str) -> DataFrame:
    """Notifications as text, each with its row_number from 1 in its file's order.

    Such a file has cells with line breaks, so one task reads it whole, and ids within the
    task that follow one another number its rows without gaps; files are numbered each from 1.
    """
    rows = csv(spark, path, ADIS_COLUMNS).withColumn("__file", F.input_file_name())
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("__at", at)
    first = F.min("__at").over(W.partitionBy("__file"))
    return rows.withColumn("row_number", F.col("__at") - first + 1).drop("__file", "__at")


def adis_typed(rows: DataFrame) -> DataFrame:
    """Dates, counts, flags and coordinates by type; markers of missing values as null."""
    out = rows.select(*(text.na_to_null(F.col(f"`{c}`"), NA_MARKERS).alias(c) if c in ADIS_COLUMNS else F.col(c) for c in rows.columns))
    columns = {c: numbers.date_of(F.col(f"`{c}`")) for c in DATES}
    columns |= {c: numbers.unsigned(F.col(f"`{c}`")) for c in NUMBERS}
    columns |= {c: numbers.tri_state(F.col(f"`{c}`")) for c in FLAGS}
    columns |= {c: numbers.decimal(F.col(c)) for c in ("Latitude", "Longitude")}
    return out.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in out.columns))


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without surrounding space and trailing separators."""
    return df.toDF(*(c.strip().rstrip(";").strip().lstrip("﻿") for c in df.columns))


def empres(spark: SparkSession, path: str) -> DataFrame:
    """EMPRES-i rows; dates are dd/mm/yyyy."""
    rows = clean_header(csv(spark, path))
    dates = [c for c in rows.columns if "date" in c.lower()]
    return rows.withColumns({c: numbers.date_of(F.col(f"`{c}`"), "dd/MM/yyyy") for c in dates})


def wahis(spark: SparkSession, path: str) -> DataFrame:
    """WAHIS rows; dates are dd.mm.yyyy."""
    rows = clean_header(csv(spark, path))
    return rows.withColumns(
        {c: numbers.date_of(F.col(c), "dd.MM.yyyy") for c in ("eventStartDate", "submissionDate") if c in rows.columns}
    )


def reports(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of reports by header names; blank is null and blank rows are dropped."""
    rows = clean_header(csv(spark, path, sep=sep))
    return rows.select(*(text.blank_to_null(F.col(f"`{c}`")).alias(c) for c in rows.columns)).dropna(how="all")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as UTC, the session's zone."""
    df = spark.read.parquet(path)
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain})
