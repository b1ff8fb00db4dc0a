"""Streams: new records through keyed state, look-back windows, late data, dead letters.

Windowed counts, sessions and alarms are extensions; the rest are the incremental stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Pass all that is there to ``each`` in batches, then stop; a later call goes on."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def with_dead_letters(
    batch: DataFrame, ok: str, good: Callable[[DataFrame], None], bad: Callable[[DataFrame], None]
) -> None:
    """Rows that pass an expression go to one sink, the others to another."""
    marked = batch.withColumn("__ok", F.coalesce(F.expr(ok), F.lit(False)))
    good(marked.where("__ok").drop("__ok"))
    bad(marked.where("not __ok").drop("__ok"))


def look_back(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    """Rows of the last days before ``now``."""
    return df.where(F.col(ts) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def tumbling(df: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Extension: counts and sums by time window and key; later rows than ``late`` are left out."""
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def sliding(df: DataFrame, ts: str, key: str, width: str = "1 day", step: str = "6 hours", late: str = "7 days") -> DataFrame:
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, width, step).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return (
        df.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def distinct_within(df: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """First row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rising(df: DataFrame, key: str, threshold: int) -> DataFrame:
    """(key, total): a row when a key's running count first reaches the threshold."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else 0
        total = before + sum(len(b) for b in batches)
        held.update((total,))
        if before < threshold <= total:
            yield pd.DataFrame({key: [k[0]], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, total bigint", "total bigint", "append", GroupStateTimeout.NoTimeout
    )
