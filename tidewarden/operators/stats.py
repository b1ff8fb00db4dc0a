"""Aggregates of dashboards: totals, shares, series, distributions, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total_by(df: DataFrame, key: str, value: str, missing: str | None = "—") -> DataFrame:
    """(key, total): sums by key; null keys under ``missing``, or dropped if that is None."""
    if missing is None:
        df = df.where(F.col(key).isNotNull())
        label = F.col(key)
    else:
        label = F.coalesce(key, F.lit(missing))
    return df.groupBy(label.alias(key)).agg(F.sum(value).alias("total"))


def total_by_domain(df: DataFrame, key: str, value: str, domain: Sequence[str]) -> DataFrame:
    """Totals of the fixed keys of a domain, those above 0."""
    known = df.where(F.col(key).isin(*domain))
    return total_by(known, key, value, None).where("total > 0")


def top(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """The n largest; ties in order of key."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(n)


def daily(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(day, total) for every day from the first to the last, 0 where nothing happened."""
    day = F.to_date(ts)
    sums = df.where(F.col(ts).isNotNull()).groupBy(day.alias("day")).agg(F.sum(value).alias("s"))
    ends = sums.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(sums, "day", "left").select("day", F.coalesce("s", F.lit(0.0)).alias("total"))


def share(df: DataFrame, value: str) -> DataFrame:
    """Rows with ``percent``, their whole-number share of all values."""
    everything = F.sum(value).over(W.partitionBy())
    return df.withColumn(
        "percent", F.when(everything > 0, F.round(100 * F.col(value) / everything)).otherwise(0.0)
    )


def scale_max(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.greatest(F.lit(1.0), F.max(value)).alias("scale"))


def risk_level(n: Column) -> Column:
    return F.when(n > 6, "high").when(n > 2, "medium").otherwise("low")


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """(column, n): the n most frequent values, null as Missing."""
    label = F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias(column)
    return top(df.groupBy(label).agg(F.count("*").alias("n")), "n", n, column)


def top_rows(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is one of the n most frequent non-null ones."""
    best = top(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), "n", n, column)
    return df.join(F.broadcast(best.select(column)), column, "left_semi")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by the given values of a column, 0 where there are none."""
    table = df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1)))
    return table.na.fill(0, list(values))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with null as a value of its own."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def monthly(df: DataFrame, date: str, *keys: str) -> DataFrame:
    """(month, keys, n): rows by month; null dates dropped, no gaps filled."""
    month = F.trunc(F.to_date(date), "month").alias("month")
    return df.where(F.col(date).isNotNull()).groupBy(month, *keys).agg(F.count("*").alias("n"))


def monthly_stack(df: DataFrame, date: str, key: str, values: Sequence[str]) -> DataFrame:
    month = F.trunc(F.to_date(date), "month").alias("month")
    table = df.where(F.col(date).isNotNull()).groupBy(month).pivot(key, list(values)).agg(F.count(F.lit(1)))
    return table.na.fill(0, list(values))


def trend(monthly_counts: DataFrame, *keys: str) -> DataFrame:
    """Extension: each month against the one before it in the table."""
    order = W.partitionBy(*keys).orderBy("month")
    before = F.lag("n").over(order)
    return monthly_counts.withColumn("before", before).withColumn("change", F.col("n") - before)


def reach(located: DataFrame, key: str, levels: tuple[str, str, str]) -> DataFrame:
    """(key, reach): local within one third-level unit, regional within one second-level one,
    national beyond; unknown where second-level units are."""
    _, second, third = levels
    a, b = F.count_distinct(second), F.count_distinct(third)
    value = (
        F.when(a > 1, "national")
        .when((a == 1) & (b > 1), "regional")
        .when((a == 1) & (b == 1), "local")
        .otherwise("unknown")
    )
    return located.groupBy(key).agg(value.alias("reach"))


def element_counts(df: DataFrame, column: str, n: int = 40) -> DataFrame:
    """(element, n): most frequent trimmed elements of an array column."""
    found = df.select(F.explode(column).alias("element")).select(F.trim("element").alias("element"))
    found = found.where("element <> ''")
    return top(counts(found, "element"), "n", n, "element")


def list_lengths(df: DataFrame, column: str) -> DataFrame:
    size = F.coalesce(F.size(column), F.lit(0))
    return df.agg(
        F.min(size).alias("min_length"),
        F.median(size).alias("median_length"),
        F.max(size).alias("max_length"),
        F.sum((size == 0).cast("bigint")).alias("empty_rows"),
    )
