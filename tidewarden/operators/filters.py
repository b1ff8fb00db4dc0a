"""Filters: selections, ranges, searches, masks and validity rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.text import FLAGS
from tidewarden.operators.selection import quantiles


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def multi_select(df: DataFrame, chosen: Mapping[str, Sequence]) -> DataFrame:
    """Rows that have one of the chosen values in each column; nothing chosen passes all.

    A null never passes a column with a choice.
    """
    return df.where(all_of([F.col(c).isin(*values) for c, values in chosen.items() if values]))


def date_range(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows within a range, ends included; a null date passes."""
    c, inside = F.col(column), []
    if first is not None:
        inside.append(c >= F.lit(first))
    if last is not None:
        inside.append(c <= F.lit(last))
    return df.where(c.isNull() | all_of(inside))


def day_range(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """``date_range`` on the day of a timestamp or its text."""
    day = "__day"
    keyed = df.withColumn(day, F.substring(F.col(column).cast("string"), 1, 10))
    return date_range(keyed, day, first, last).drop(day)


def search(df: DataFrame, columns: Sequence[str | Column], query: str) -> DataFrame:
    """Rows whose columns, joined and in lower case, have the query's text."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    joined = F.lower(F.concat_ws(" ", *columns))
    return df.where(F.contains(joined, F.lit(wanted)))


def optional_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in every given column; a value of None is no condition."""
    return df.where(all_of([F.col(c) == v for c, v in wanted.items() if v is not None]))


def pattern_mask(patterns: Mapping[str, str], every: bool = False) -> Column:
    """Whether any (or every) column matches its pattern; null counts as blank text."""
    found = [F.coalesce(F.col(c), F.lit("")).rlike(FLAGS + p) for c, p in patterns.items()]
    return all_of(found) if every else any_of(found)


def any_known(columns: Sequence[str]) -> Column:
    return any_of([F.col(c).isNotNull() for c in columns])


def quantile_trim(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within two exact quantiles of a column."""
    first, last = quantiles(df, column, (low, high))
    return df.limit(0) if first is None else df.where(F.col(column).between(first, last))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def has_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.dropna(subset=[lat, lon])


def complete(columns: Sequence[str]) -> Column:
    """Whether every column is neither null nor blank."""
    return all_of([F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in columns])


def well_formed_key(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9-]+\|[a-z0-9-]+\|(\d{4}-\d{2}|unknown)$")


def malformed(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required columns, the others: the dead letters)."""
    ok = all_of([F.col(c).isNotNull() for c in required])
    return df.where(ok), df.where(~ok)


def document_links(df: DataFrame, href: str = "href", text: str = "text") -> DataFrame:
    """Links to PDF documents whose address or text names avian influenza."""
    address, label = F.coalesce(href, F.lit("")), F.coalesce(text, F.lit(""))
    is_document = F.lower(address).rlike(r"\.pdf|document/download")
    return df.where(is_document & F.lower(F.concat_ws(" ", address, label)).rlike("hpai"))


def mostly_missing(profile: DataFrame, percent: float = 80.0) -> DataFrame:
    return profile.where(F.col("missing_percent") >= percent)
