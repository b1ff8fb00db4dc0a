"""Cases of the test tables: events with places, gaps and labels by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources import tabular

#: The same rules in SQL, as a common table expression.
CASES_SQL = """cases AS (
  SELECT event_id, user_id, value,
    CASE WHEN event_id % 23 <> 0 THEN ts END AS reported_at,
    CASE WHEN event_id % 19 <> 0 THEN event_type END AS disease,
    CASE event_id % 4 WHEN 0 THEN 'wild birds' WHEN 1 THEN 'poultry' WHEN 2 THEN 'captive' END
      AS population,
    CASE WHEN event_id % 17 <> 0 THEN 45 + (user_id * 37 % 500) / 100e0 END AS lat,
    CASE WHEN event_id % 17 <> 0 THEN 5 + (user_id * 91 % 700) / 100e0 END AS lon,
    CAST(floor(value) AS INTEGER) AS cases,
    'NATION_' || (user_id % 25) AS country,
    CASE WHEN user_id % 11 <> 0 THEN 'A' || (user_id % 7) END AS admin1,
    CASE WHEN event_id % 3 <> 0 THEN 'B' || (user_id % 13) END AS admin2
  FROM events)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tabular.table(spark, f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id",
        "user_id",
        "value",
        F.when(i % 23 != 0, F.col("ts")).alias("reported_at"),
        F.when(i % 19 != 0, F.col("event_type")).alias("disease"),
        F.when(i % 4 == 0, "wild birds").when(i % 4 == 1, "poultry").when(i % 4 == 2, "captive").alias("population"),
        F.when(i % 17 != 0, 45 + (u * 37 % 500) / 100.0).alias("lat"),
        F.when(i % 17 != 0, 5 + (u * 91 % 700) / 100.0).alias("lon"),
        F.floor("value").cast("int").alias("cases"),
        F.concat(F.lit("NATION_"), (u % 25).cast("string")).alias("country"),
        F.when(u % 11 != 0, F.concat(F.lit("A"), (u % 7).cast("string"))).alias("admin1"),
        F.when(i % 3 != 0, F.concat(F.lit("B"), (u % 13).cast("string"))).alias("admin2"),
    )


#: Scored cases in SQL: distance, density of the nine cells around, severity, score, priority.
SCORED_SQL = (
    CASES_SQL
    + """,
cells AS (SELECT CAST(round(lat / 0.1e0) AS INTEGER) AS r, CAST(round(lon / 0.1e0) AS INTEGER) AS c,
    count(*) AS n FROM cases WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2),
around AS (SELECT a.r, a.c, sum(b.n) AS neighbours FROM cells a JOIN cells b
    ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2),
placed AS (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 2 * 6371e0 * asin(least(1e0, sqrt(
    pow(sin(radians(lat - 46.946461621956566e0) / 2), 2) + cos(radians(46.946461621956566e0))
    * cos(radians(lat)) * pow(sin(radians(lon - 7.4442526092578625e0) / 2), 2)))) END AS distance_km
  FROM cases),
near AS (SELECT *, CASE WHEN distance_km IS NULL THEN 1e0 ELSE exp(-distance_km / 250e0) END AS near
  FROM placed),
scored AS (SELECT near.*, coalesce(neighbours, 0) AS neighbours,
    least(1e0, near * (1 + 0.15e0 * least(1e0, coalesce(neighbours, 0) / 150e0)
      + 0.15e0 * least(1e0, log10(cases + 1) / log10(500e0)))) AS score
  FROM near LEFT JOIN around ON CAST(round(lat / 0.1e0) AS INTEGER) = around.r
    AND CAST(round(lon / 0.1e0) AS INTEGER) = around.c),
ranked AS (SELECT *, CASE WHEN score >= 0.8e0 THEN 1 WHEN score >= 0.5e0 THEN 2 ELSE 3 END
    AS priority FROM scored)"""
)
