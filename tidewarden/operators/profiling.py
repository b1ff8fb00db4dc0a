"""Profiles of tables: missing values, distinct values, keys, ranges, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators import selection


#: Bytes of a value's text that are compared themselves; of a longer one its SHA-256 is.
SHOWN = 64


def _comparable(df: DataFrame, name: str) -> Column:
    """A column's values as texts that differ where the values do."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(name)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = (c + F.lit(0).cast(kind)).cast("string")  # both zeros are one
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")  # one local time may come twice
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    else:
        text = c.cast("string")
    return F.when(F.octet_length(text) <= SHOWN, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(place, known, n_unique) of columns by their place from 0; those without values are left
    out. A row is a (place, text) pair for each column, counted by one exchange with partial
    sums: its rows are a task's distinct values, and of bounded size."""
    pairs = [F.struct(F.lit(i).alias("place"), _comparable(df, c).alias("value")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*pairs))).where("value is not null")
    each = values.groupBy("place", "value").agg(F.count("*").alias("n"))
    return each.groupBy("place").agg(F.sum("n").alias("known"), F.count("*").alias("n_unique"))


def schema_profile(df: DataFrame) -> DataFrame:
    """(column_name, kind, missing, missing_percent, n_unique)."""
    names = [F.struct(F.lit(i).alias("at"), F.lit(n).alias("column_name"), F.lit(k).alias("kind")) for i, (n, k) in enumerate(df.dtypes)]
    total = df.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*names)))
    counts = distinct_counts(df, df.columns)
    missing = F.col("rows") - F.coalesce("known", F.lit(0))
    return total.join(F.broadcast(counts), F.col("at") == F.col("place"), "left").select(
        "column_name",
        "kind",
        missing.alias("missing"),
        F.when(F.col("rows") > 0, F.round(100 * missing / F.col("rows"), 2)).otherwise(0.0).alias("missing_percent"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
    )


def date_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, first_date, last_date, missing)."""
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            F.min(F.to_date(c)).alias(f"a{i}"),
            F.max(F.to_date(c)).alias(f"b{i}"),
            F.sum(F.col(c).isNull().cast("bigint")).alias(f"m{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"a{i}").alias("first_date"),
            F.col(f"b{i}").alias("last_date"),
            F.col(f"m{i}").alias("missing"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def overview(df: DataFrame, distinct: Sequence[str], date: str) -> DataFrame:
    """One row: n_rows, n_ of the distinct values of each column, first_date, last_date."""
    one = df.agg(F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    counts = distinct_counts(df, distinct).agg(
        *(F.coalesce(F.max(F.when(F.col("place") == i, F.col("n_unique"))), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(distinct))
    )
    return one.join(F.broadcast(counts)).select("n_rows", *(f"n_{c}" for c in distinct), "first_date", "last_date")


def describe(df: DataFrame, column: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, deviation, least, exact quantiles, greatest."""
    found = selection.quantiles(df, column, quantiles)
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("least"),
        *(F.lit(v).cast("double").alias(f"q{round(q * 100):02d}") for q, v in zip(quantiles, found, strict=True)),
        F.max(column).alias("greatest"),
    )


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_duplicates): rows beyond the first of equal ones; nulls equal each other."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def key_check(df: DataFrame, column: str) -> DataFrame:
    """Known, distinct and repeated values of what should be a key."""
    counts = distinct_counts(df, [column])
    known, unique = (F.coalesce(c, F.lit(0)) for c in ("known", "n_unique"))
    one = df.agg(F.count("*").alias("n_rows")).join(F.broadcast(counts), how="left", on=F.col("place") == 0)
    return one.select("n_rows", known.alias("n_known"), unique.alias("n_unique"), (known - unique).alias("n_repeated"))


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n_rows) of a pipeline's tables."""
    out = None
    for name, df in stages:
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def labelled_union(parts: Sequence[tuple[str, DataFrame]], label: str = "artifact") -> DataFrame:
    out = None
    for name, df in parts:
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def vector_sizes(df: DataFrame, column: str) -> DataFrame:
    """Numbers of vectors and of empty ones; sizes of those that are not empty."""
    size = F.coalesce(F.size(column), F.lit(0))
    full = F.when(size > 0, size)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum((size == 0).cast("bigint")).alias("n_empty"),
        F.min(full).alias("min_size"),
        F.median(full).alias("median_size"),
        F.max(full).alias("max_size"),
    )


def text_extremes(df: DataFrame, column: str, n: int, key: str, longest: bool = True) -> DataFrame:
    size = F.length(column)
    order = size.desc_nulls_last() if longest else size.asc_nulls_last()
    return df.where(F.col(column).isNotNull()).orderBy(order, key).limit(n)


def sample_rank(key: str, seed: int) -> Column:
    """Where a row stands in a sample: the MD5 of seed and key, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def sample(df: DataFrame, n: int, key: str, seed: int = 42, by: str | None = None) -> DataFrame:
    """n rows, of each group ``by`` a column if one is given: those of the least MD5s, ties by key.

    Such samples can be merged: that of a union is that of its parts' samples. So tasks keep n
    rows a group before an exchange, and hot groups meet in shares before they meet whole.
    """
    if by is None:
        return df.orderBy(sample_rank(key, seed), key).limit(n)
    ranked = df.withColumn("__rank", sample_rank(key, seed))
    for share in (F.substring("__rank", 1, 1), F.lit("")):
        order = W.partitionBy(by, share).orderBy("__rank", key)
        ranked = ranked.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n)
    return ranked.drop("__rank", "__place")


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that the table has, in the given order."""
    return df.select(*(c for c in columns if c in df.columns))
