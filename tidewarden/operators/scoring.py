"""Relevance of cases: proximity, density of neighbouring cells, severity, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.functions import geo


def cell_counts(cases: DataFrame, size: float = 0.1) -> DataFrame:
    """(cell_lat, cell_lon, n): located cases in each grid cell."""
    return (
        cases.where("lat is not null and lon is not null")
        .groupBy(
            geo.grid_cell(F.col("lat"), size).alias("cell_lat"),
            geo.grid_cell(F.col("lon"), size).alias("cell_lon"),
        )
        .agg(F.count("*").alias("n"))
    )


def neighbour_counts(cells: DataFrame) -> DataFrame:
    """(cell_lat, cell_lon, neighbours): cases in the nine cells around, its own included.

    Each cell is dealt to the nine it is a neighbour of and summed there: the histogram
    grows ninefold, cases are never paired.
    """
    offsets = F.array(
        *(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))
    )
    spread = cells.select("cell_lat", "cell_lon", "n", F.explode(offsets).alias("o")).select(
        (F.col("cell_lat") + F.col("o.a")).alias("cell_lat"),
        (F.col("cell_lon") + F.col("o.b")).alias("cell_lon"),
        "n",
    )
    return spread.groupBy("cell_lat", "cell_lon").agg(F.sum("n").alias("neighbours"))


def scored(
    cases: DataFrame, origin: geo.Origin = geo.BERN_SCORE, radius_km: float = 250.0
) -> DataFrame:
    """Cases with distance_km, near, neighbours, score and priority."""
    around = neighbour_counts(cell_counts(cases))
    located = (
        cases.withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lon"), origin))
        .withColumn("near", geo.proximity(F.col("distance_km"), radius_km))
        .withColumn("cell_lat", geo.grid_cell(F.col("lat")))
        .withColumn("cell_lon", geo.grid_cell(F.col("lon")))
    )
    joined = located.join(around, ["cell_lat", "cell_lon"], "left")
    value = geo.score(
        F.col("near"),
        geo.density(F.coalesce("neighbours", F.lit(0))),
        geo.severity(F.coalesce("cases", F.lit(0))),
    )
    return joined.withColumn("score", value).withColumn("priority", geo.priority(value))


def ranked(cases: DataFrame, by: str = "score", key: str = "event_id") -> DataFrame:
    return cases.orderBy(F.col(by).desc_nulls_last(), F.col(key))


def heat(cases: DataFrame, size: float = 0.5, radius: float = 1.0, reach: int = 3) -> DataFrame:
    """(cell_lat, cell_lon, heat): a Gaussian kernel of weights around located cases.

    Weights are summed by cell first; each cell then reaches ``reach`` cells each way.
    """
    cells = (
        cases.where("lat is not null and lon is not null")
        .groupBy(
            geo.grid_cell(F.col("lat"), size).alias("cell_lat"),
            geo.grid_cell(F.col("lon"), size).alias("cell_lon"),
        )
        .agg(F.sum("weight").alias("weight"))
    )
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.select("*", F.explode(steps).alias("a")).select("*", F.explode(steps).alias("b"))
    distance = F.hypot(F.col("a") * size, F.col("b") * size)
    return (
        spread.select(
            (F.col("cell_lat") + F.col("a")).alias("cell_lat"),
            (F.col("cell_lon") + F.col("b")).alias("cell_lon"),
            (F.col("weight") * geo.gaussian_kernel(distance, radius)).alias("w"),
        )
        .groupBy("cell_lat", "cell_lon")
        .agg(F.sum("w").alias("heat"))
    )


def centre_score(cases: DataFrame) -> DataFrame:
    """One row: mean score as 0 to 100 and its band."""
    value = F.coalesce(F.round(100 * F.avg("score")), F.lit(0.0)).cast("int")
    return cases.agg(value.alias("centre_score")).withColumn(
        "band",
        F.when(F.col("centre_score") >= 66, "high")
        .when(F.col("centre_score") >= 33, "medium")
        .otherwise("low"),
    )


def timeline(cases: DataFrame, ts: str = "reported_at") -> DataFrame:
    """Cases with t, their time scaled to 0 at the first and 1 at the last."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    ends = cases.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    if ends["a"] is None:
        return cases.withColumn("t", F.lit(None).cast("double"))
    span = (ends["b"] - ends["a"]) or 1.0
    return cases.withColumn("t", (seconds - ends["a"]) / span)


def playback(cases: DataFrame, step_hours: int = 6, ts: str = "reported_at") -> DataFrame:
    """(step, shown): cases up to the end of each time step that has any.

    Counts are summed by step first, so the running sum reads a row for each step.
    """
    step = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (3600 * step_hours))
    counts = cases.where(F.col(ts).isNotNull()).groupBy(step.alias("step")).agg(
        F.count("*").alias("n")
    )
    running = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select("step", F.sum("n").over(running).alias("shown"))
