"""Exports: events of notifications, report tables, views, counters, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import geo, keys, numbers, text
from tidewarden.operators import listing, scoring
from tidewarden.triples.emit import event_month

# Columns of exported tables in their order, and disease codes.
EVENT_COLUMNS = (
    "disease",
    "subtype",
    "species",
    "population",
    "source",
    "external_id",
    "occurred_at",
    "admin_level_1",
    "admin_level_2",
    "admin_level_3",
    "latitude",
    "longitude",
    "cases",
    "deaths",
    "susceptible",
    "distance_km",
    "relevance_score",
    "priority",
)
REPORT_COLUMNS = (
    "report_id",
    "source_id",
    "source_name",
    "source_document_title",
    "source_link",
    "source_publication_date",
    "source_retrieved_at",
    "disease_name",
    "disease_type",
    "country_or_territory",
    "administrative_division_level_1",
    "administrative_division_level_2",
    "administrative_division_level_3",
    "is_in_europe",
    "species",
    "cases",
    "dead",
    "killed",
    "slaughtered",
    "vaccinated",
    "confirmation_date",
    "status",
    "relevance_level",
    "relevance_rationale",
    "severity_level",
    "severity_rationale",
    "reach_level",
    "reach_rationale",
    "has_consequences",
    "consequences",
    "control_measures",
    "prevention_measures",
    "research_references",
)
DISEASE_CODES = (
    ("hpai", "HPAI"),
    ("geflügelpest (hpai)", "HPAI"),
    ("geflügelpest", "HPAI"),
    ("mks", "MKS"),
    ("maul- und klauenseuche", "MKS"),
    ("asp", "ASP"),
    ("afrikanische schweinepest", "ASP"),
    ("bvd", "BVD"),
    ("bovine virusdiarrhoe", "BVD"),
    ("bt", "BT"),
    ("blauzungenkrankheit", "BT"),
)


def adis_events(rows: DataFrame, origin: geo.Origin = geo.BERN_EXPORT) -> DataFrame:
    """Events of ADIS notifications, all of whose columns are text."""

    def col(name: str) -> Column:
        return text.na_to_null(F.col(f"`{name}`"))

    lat, lon = numbers.decimal(col("Latitude")), numbers.decimal(col("Longitude"))
    distance = geo.haversine_km(lat, lon, origin, clamp=False)
    return rows.select(
        col("Disease name").alias("disease"),
        col("Disease type").alias("subtype"),
        col("Species 1").alias("species"),
        listing.population(col("Wildlife type 1"), col("Production Type 1"), col("Epidemiological unit")).alias(
            "population"
        ),
        F.lit("adis").alias("source"),
        col("Reference").alias("external_id"),
        numbers.first_known(
            col("Confirmation date"), col("Suspicion/Start date"), col("Submitted on")
        ).alias("occurred_at"),
        *(col(f"Administrative division level {i}").alias(f"admin_level_{i}") for i in (1, 2, 3)),
        numbers.half_even(lat, 6).alias("latitude"),
        numbers.half_even(lon, 6).alias("longitude"),
        numbers.unsigned(col("Cases 1")).alias("cases"),
        numbers.unsigned(col("Dead 1")).alias("deaths"),
        numbers.unsigned(col("Susceptible 1")).alias("susceptible"),
        numbers.half_even(distance, 2).alias("distance_km"),
        F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("int").alias("priority"),
    )


def conversion_counters(rows: DataFrame) -> DataFrame:
    """One row: rows read, skipped, events, fallbacks of dates, missing coordinates, concepts."""
    known = text.blank_to_null(F.col("Reference")).isNotNull()
    month, source = event_month()
    lat = numbers.decimal(text.na_to_null(F.col("Latitude")))
    lon = numbers.decimal(text.na_to_null(F.col("Longitude")))
    disease = text.blank_to_null(F.col("Disease name"))
    country = text.blank_to_null(F.col("Country/Territory"))
    key = keys.situation_key(F.coalesce(disease, F.lit("unknown")), F.coalesce(country, F.lit("unknown")), month)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return rows.agg(
        F.count("*").alias("rows"),
        count(~known).alias("skipped"),
        count(known).alias("events"),
        count(known & (source != "confirmation")).alias("fallback"),
        count(known & (source == "unknown")).alias("undated"),
        count(known & (lat.isNull() | lon.isNull())).alias("missing_coordinates"),
        F.count_distinct(F.when(known, key)).alias("situations"),
        F.count_distinct(F.when(known, disease)).alias("diseases"),
        F.count_distinct(F.when(known, text.na_to_null(F.col("`Species 1`")))).alias("species"),
    )


def report_view(reports: DataFrame) -> DataFrame:
    """Reports as views: names of the interface, day of the date, German label."""
    return reports.select(
        "id",
        "source",
        "title",
        "url",
        "teaser",
        "body",
        F.date_format("report_date", "yyyy-MM-dd").alias("reportDate"),
        *(F.col(f"admin_level_{i}").alias(f"admin{i}") for i in (1, 2, 3)),
        F.col("relevance_score").cast("double").alias("relevanceScore"),
        listing.relevance_label(F.col("relevance")).alias("relevanceLabel"),
    )


def detail_rows(cases: DataFrame, origin: geo.Origin = geo.BERN_VIEW, radius_km: float = 250.0) -> DataFrame:
    """Cases as rows of a list; one without coordinates is near and at distance 0."""
    distance = geo.haversine_km(F.col("lat"), F.col("lon"), origin)
    near = geo.proximity(distance, radius_km)
    return cases.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"),
        F.coalesce("disease", F.lit("")).alias("disease"),
        F.coalesce(listing.place(F.col("admin2"), F.col("admin1"), F.col("country")), F.lit("")).alias("location"),
        F.coalesce(F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm"), F.lit("")).alias("reportedAt"),
        F.coalesce(distance, F.lit(0.0)).alias("distance"),
        near.alias("relevance"),
        F.when(near >= 0.8, "high").when(near >= 0.5, "medium").otherwise("low").alias("priority"),
    )


def map_place(*levels: Column) -> Column:
    """Place on the map: the first known of admin1, admin2, country."""
    return listing.place(*levels)


def disease_code(c: Column) -> Column:
    return listing.mapped(F.nullif(c, F.lit("")), DISEASE_CODES, F.nullif(c, F.lit("")))


def colour(code: Column, table: Sequence[tuple[str, str]], fallback: str) -> Column:
    """Marker colour of a disease code."""
    return listing.mapped(code, tuple((k.lower(), v) for k, v in table), F.lit(fallback))


def totals(events: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of a dashboard's totals; what is not stored here counts as 0."""
    counted = events.agg(F.count("*").alias("outbreakEvents"))
    others = reports.agg(F.count("*").alias("paffReports"))
    nothing = {n: F.lit(0).cast("bigint") for n in ("outbreakSituations", "paffSituationStatements", "evidenceSnippets")}
    one = counted.withColumn("one", F.lit(1)).join(F.broadcast(others.withColumn("one", F.lit(1))), "one")
    return one.drop("one").withColumns(nothing)


def totals_by_kind(cases: DataFrame, kinds: Sequence[str], column: str = "disease") -> DataFrame:
    """One row with the number of cases of each kind."""
    return cases.agg(*(F.count(F.when(F.col(column) == k, 1)).alias(f"n_{k}") for k in kinds))


def scored_events(cases: DataFrame) -> DataFrame:
    """Events with score and priority, rounded for storage."""
    found = scoring.scored(cases)
    return found.withColumn("score", F.round("score", 2)).withColumn("distance_km", F.round("distance_km", 2))
