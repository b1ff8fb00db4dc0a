"""As-of joins of two tables: a sweep over their sorted union, with what is carried over ranges.

Both sides are dealt by ranges of (place, side, a hash of the row), so rows of one place, however
many, spread over ranges. Within a range a running window hands each point the last waypoint
before it; the last waypoint of each range, a row a range, is handed on to the ranges after.
Nothing is collected, no pair is made, and each table is exchanged and sorted once.

Defined cases: a point without a place has no waypoint, and a waypoint without one is none; of
waypoints at one place the least in their other columns counts; a table without waypoints gives
nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.functions import geo
from tidewarden.storage import written


def as_of(points: DataFrame, waypoints: DataFrame, t: str, at: str, before: bool = False, name: str = "waypoint") -> DataFrame:
    """Points with the last waypoint, a struct of its columns, whose ``at`` is not above t (is
    below it, with ``before``); null without one."""
    own = waypoints.where(F.col(at).isNotNull())
    place = own.schema[at].dataType
    row = F.struct(F.col(at), *(F.col(c) for c in own.columns if c != at))
    own = own.groupBy(F.col(at).alias("__at")).agg(F.min(row).alias("__way"))
    # At one place, waypoints stand before the points that may have them.
    side = 1 if before else 0
    left = points.select(
        F.col(t).cast(place).alias("__at"), F.lit(1 - side).alias("__side"), F.struct(*points.columns).alias("__point")
    )
    both = left.unionByName(own.select("__at", F.lit(side).alias("__side"), "__way"), allowMissingColumns=True)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("__tie", F.xxhash64(F.to_json("__point")))
    dealt = both.repartitionByRange(parts, "__at", "__side", "__tie").withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "sweep")
    order = ("__at", "__side", "__tie")
    last = dealt.where("__way is not null").groupBy("__part").agg(F.max(F.struct(*order, "__way")).alias("__last"))
    # A row for each range.
    ranges = dealt.select("__part").distinct().join(last, "__part", "left")
    carried = ranges.select(
        "__part",
        F.last("__last.__way", ignorenulls=True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__carried"),
    )
    window = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = dealt.withColumn("__here", F.last("__way", ignorenulls=True).over(window)).where("__point is not null")
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__here", "__carried"))
    return swept.join(F.broadcast(carried), "__part").select("__point.*", found.alias(name))


def following(waypoints: DataFrame, at: str) -> DataFrame:
    """Waypoints, the least of each place, with the next one as ``next``."""
    own = waypoints.where(F.col(at).isNotNull())
    rest = [c for c in own.columns if c != at]
    own = own.groupBy(at).agg(F.min(F.struct(*rest)).alias("__rest")).select(at, "__rest.*") if rest else own.distinct()
    # The next is the last of the falling order: a sweep over negated places.
    back = own.select(*own.columns, (-F.col(at)).alias("__back"))
    found = as_of(back, back, "__back", "__back", before=True, name="next")
    return found.withColumn("next", F.when(F.col("next").isNotNull(), F.struct(*(F.col(f"next.{c}").alias(c) for c in own.columns)))).drop(
        "__back"
    )


def nearest(points: DataFrame, waypoints: DataFrame, t: str, at: str, first: str) -> DataFrame:
    """Points with ``waypoint``: the one nearest in t; of two as near the least ``first``."""
    linked = following(waypoints, at)
    swept = as_of(points, linked, t, at)
    head = linked.agg(F.min_by(F.struct(*waypoints.columns), at).alias("__head"))  # for points before all
    names = waypoints.columns

    def way(c: Column) -> Column:
        distance = F.abs(F.col(t) - c[at])
        return F.when(c.isNotNull(), F.struct(distance.alias("d"), c[first].alias("first"), F.struct(*(c[n].alias(n) for n in names)).alias("w")))

    here = F.col("waypoint")
    best = F.least(way(here), way(here["next"]), way(F.when(here.isNull() & F.col(t).isNotNull(), F.col("__head"))))
    return swept.join(F.broadcast(head)).select(*points.columns, best["w"].alias("waypoint"))


def piecewise(points: DataFrame, waypoints: DataFrame, t: str, at: str, value: str) -> DataFrame:
    """Points with ``path_value``: interpolated in the first segment whose end is not before t,
    drawn out before the first waypoint, the last value beyond the last."""
    linked = following(waypoints.select(at, value), at)
    swept = as_of(points, linked, t, at, before=True)
    head = linked.agg(F.min_by(F.struct(at, value, "next"), at).alias("__head"))
    here = F.coalesce("waypoint", F.when(F.col(t).isNotNull(), F.col("__head")))
    part = geo.interpolate(F.col(t), here[at], here[value], here["next"][at], here["next"][value])
    return swept.join(F.broadcast(head)).select(
        *points.columns, F.when(here["next"].isNull(), here[value]).otherwise(part).alias("path_value")
    )
