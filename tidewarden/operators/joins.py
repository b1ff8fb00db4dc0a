"""Joins by range, nearest value, bridge, alias and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import geo, keys


def inline(df: DataFrame, column: str, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Join to a table of literals, whose first column is ``column``."""
    schema = ", ".join(f"{n} string" for n in names)
    table = df.sparkSession.createDataFrame([tuple(map(str, r)) for r in rows], schema)
    return df.join(F.broadcast(table), column)


def bridge(events: DataFrame, links: DataFrame, reports: DataFrame) -> DataFrame:
    """Events with their reports, by a table of (event_id, report_id)."""
    return events.join(links, "event_id").join(reports, "report_id")


def peers(events: DataFrame, key: str = "situation_key") -> DataFrame:
    """(event_id, peer_id) of events that share a situation, each its own peer."""
    other = events.select(key, F.col("event_id").alias("peer_id"))
    return events.select(key, "event_id").join(other, key).select("event_id", "peer_id")


def peer_counts(events: DataFrame, key: str = "situation_key") -> DataFrame:
    """(event_id, n_peers, last_peer): how many events share the situation and the last of them,
    from one row for each situation instead of the pairs."""
    known = events.where(F.col(key).isNotNull())
    found = known.groupBy(key).agg(F.count("*").alias("n_peers"), F.max("event_id").alias("last_peer"))
    return known.select(key, "event_id").join(found, key).select("event_id", "n_peers", "last_peer")


def nearest(points: DataFrame, waypoints: Sequence[tuple[float, float]], t: str = "t") -> DataFrame:
    """Points with ``waypoint`` and ``waypoint_value``: the one nearest in t, the first of ties."""
    table = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(float(at)).alias("at"), F.lit(float(v)).alias("v"))
            for i, (at, v) in enumerate(waypoints)
        )
    )
    best = F.array_min(
        F.transform(table, lambda w: F.struct(F.abs(F.col(t) - w["at"]).alias("d"), w["i"].alias("i"), w["v"].alias("v")))
    )
    return points.withColumn("__best", best).select(
        *points.columns, F.col("__best.i").alias("waypoint"), F.col("__best.v").alias("waypoint_value")
    )


def piecewise(points: DataFrame, waypoints: Sequence[tuple[float, float]], t: str = "t") -> DataFrame:
    """Points with ``path_value``: interpolated in the first segment whose end is not before
    t; the last value beyond."""
    value = F.lit(float(waypoints[-1][1]))
    segments = list(zip(waypoints, waypoints[1:], strict=False))
    for (a, va), (b, vb) in reversed(segments):
        part = geo.interpolate(F.col(t), *(F.lit(float(x)) for x in (a, va, b, vb)))
        value = F.when(F.col(t) <= b, part).otherwise(value)
    return points.withColumn("path_value", value)


def link_reports(
    reports: DataFrame, situations: DataFrame, countries: DataFrame, diseases: DataFrame
) -> DataFrame:
    """(report_id, situation_key) of reports that meet a situation, whatever language their
    country and disease are named in. Alias tables are (alias, name)."""
    country = countries.select(F.lower("alias").alias("c_alias"), F.col("name").alias("c_name"))
    disease = diseases.select(F.lower("alias").alias("d_alias"), F.col("name").alias("d_name"))
    keyed = (
        reports.join(country, F.lower("country") == F.col("c_alias"), "left")
        .join(disease, F.lower("disease") == F.col("d_alias"), "left")
        .withColumn(
            "situation_key",
            keys.report_situation_key(
                F.coalesce("d_name", "disease"), F.coalesce("c_name", "country"), F.col("month")
            ),
        )
    )
    return keyed.join(situations.select("situation_key"), "situation_key", "left_semi").select(
        "report_id", "situation_key"
    )


def nearest_concept(vectors: DataFrame, concepts: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """Vectors with ``concept`` and ``similarity``: the nearest of a fixed list by cosine.

    Concepts are a vocabulary of bounded size and stand in the plan as literals, so vectors
    are compared in their row and never shuffled.
    """
    candidates = F.array(
        *(
            F.struct(
                geo.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in v))).alias("s"),
                F.lit(-i).alias("i"),
                F.lit(name).alias("name"),
            )
            for i, (name, v) in enumerate(concepts)
        )
    )
    best = F.array_max(candidates)
    return vectors.withColumn("__best", best).select(
        *vectors.columns, F.col("__best.name").alias("concept"), F.col("__best.s").alias("similarity")
    )


def orphans(events: DataFrame, situations: DataFrame, key: str = "situation_key") -> dict[str, DataFrame]:
    """Events without a situation, situations without an event, events with several."""
    return {
        "orphan_events": events.join(situations.select(key), key, "left_anti"),
        "orphan_situations": situations.join(events.select(key), key, "left_anti"),
        "multi_links": events.groupBy("event_id")
        .agg(F.count_distinct(key).alias("n"))
        .where("n > 1"),
    }
