"""Synthetic events: weighted streams along a path, counts with invariants, hotspots.

An event is made for each id of a table, from numbers that MD5 gives for seed, id and name, so
that the same come out however rows are dealt, and in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.joins import piecewise


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def gaussian(seed: int, *parts: Column | str) -> Column:
    """Standard normal from two uniforms."""
    u = F.greatest(uniform(seed, *parts, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(6.283185307179586 * uniform(seed, *parts, F.lit("v")))


def pick(u: Column, weighted: Sequence[tuple[str, float]]) -> Column:
    """A name by cumulative weight."""
    total, at = sum(w for _, w in weighted), 0.0
    out = F.lit(weighted[-1][0])
    bounds = []
    for name, w in weighted:
        at += w
        bounds.append((name, at / total))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, F.lit(name)).otherwise(out)
    return out


def counts(population: Column, u: Column, v: Column, w: Column) -> tuple[Column, Column, Column]:
    """(susceptible, cases, dead) with dead <= cases <= susceptible."""
    size = F.when(population == "poultry", 20_000).when(population == "captive", 200).otherwise(50)
    susceptible = F.greatest(F.lit(1), F.floor(size * u)).cast("int")
    cases = F.least(susceptible, F.greatest(F.lit(1), F.floor(susceptible * v))).cast("int")
    dead = F.least(cases, F.floor(cases * w)).cast("int")
    return susceptible, cases, dead


def flyway_events(ids: DataFrame, seed: int = 42, days: int = 365) -> DataFrame:
    """An event of weighted streams for each event_id; time, place and counts from uniforms."""
    path = ((0.0, 55.0), (0.4, 50.0), (0.7, 47.5), (1.0, 44.0))
    rows = ids.select("event_id")
    t = F.pow(uniform(seed, "event_id", F.lit("t")), 0.7)
    late = gaussian(seed, "event_id", F.lit("late")) * 3 / days
    rows = rows.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), t + late)))
    rows = piecewise(rows, path).withColumnRenamed("path_value", "path_lat")
    stream = pick(uniform(seed, "event_id", F.lit("s")), (("west", 3.0), ("central", 5.0), ("swiss", 2.0)))
    population = pick(uniform(seed, "event_id", F.lit("p")), (("wild", 6.0), ("poultry", 3.0), ("captive", 1.0)))
    rows = rows.withColumn("stream", stream).withColumn("population", population)
    susceptible, cases, dead = counts(
        F.col("population"), *(uniform(seed, "event_id", F.lit(x)) for x in ("a", "b", "c"))
    )
    lon = F.when(F.col("stream") == "west", 2.0).when(F.col("stream") == "central", 11.0).otherwise(8.0)
    return rows.select(
        "event_id",
        "stream",
        "population",
        "t",
        (F.col("path_lat") + 0.5 * gaussian(seed, "event_id", F.lit("lat"))).alias("lat"),
        (lon + 0.7 * gaussian(seed, "event_id", F.lit("lon"))).alias("lon"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * days * 86_400).alias("reported_at"),
        susceptible.alias("susceptible"),
        cases.alias("cases"),
        dead.alias("dead"),
    )


def nullable(df: DataFrame, key: str, **every: int) -> DataFrame:
    """Rows whose columns are null on each so many-th key."""
    return df.withColumns({c: F.when(F.col(key) % n != 0, F.col(c)) for c, n in every.items()})


#: Hotspots of the second generator: name, latitude, longitude, weight; fixed values.
HOTSPOTS = (
    ("lake", 47.55, 9.4, 4.0),
    ("plain", 46.95, 7.3, 3.0),
    ("river", 47.5, 7.8, 2.0),
    ("valley", 46.2, 6.2, 1.0),
)


def hotspot_events(ids: DataFrame, seed: int = 42) -> DataFrame:
    """An event for each event_id around hotspots, which are picked by cumulative weight."""
    rows = ids.select("event_id").withColumn(
        "hotspot", pick(uniform(seed, "event_id", F.lit("h")), [(name, w) for name, _, _, w in HOTSPOTS])
    )
    lat = F.coalesce(*(F.when(F.col("hotspot") == name, F.lit(a)) for name, a, _, _ in HOTSPOTS))
    lon = F.coalesce(*(F.when(F.col("hotspot") == name, F.lit(b)) for name, _, b, _ in HOTSPOTS))
    return rows.select(
        "event_id",
        "hotspot",
        (lat + 0.1 * gaussian(seed, "event_id", F.lit("lat"))).alias("lat"),
        (lon + 0.1 * gaussian(seed, "event_id", F.lit("lon"))).alias("lon"),
    )


def lookups(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(id, name) of a lookup table: each name once, numbered in order."""
    unique = list(dict.fromkeys(names))
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(unique)], "id int, name string")


def weighted_by_repetition(u: Column, weighted: Sequence[tuple[str, int]]) -> Column:
    """A name from a list that repeats each as often as its weight."""
    every = F.array(*(F.lit(n) for n, w in weighted for _ in range(w)))
    return F.get(every, F.floor(u * F.size(every)).cast("int"))
