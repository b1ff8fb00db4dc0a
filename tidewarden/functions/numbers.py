"""Numbers and dates from text, with null for what does not parse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names of long German dates and their numbers, fixed values.
GERMAN_MONTHS = {
    "Januar": 1,
    "Februar": 2,
    "März": 3,
    "Maerz": 3,
    "April": 4,
    "Mai": 5,
    "Juni": 6,
    "Juli": 7,
    "August": 8,
    "September": 9,
    "Oktober": 10,
    "November": 11,
    "Dezember": 12,
}
LONG_DATE = r"(\d{1,2})\s+([A-Za-zÄÖÜäöüß]+)\s+(\d{4})"


def decimal(c: Column) -> Column:
    """Double of text with a decimal comma or point."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def unsigned(c: Column) -> Column:
    """Whole number of text, fractions cut off; null if negative after that."""
    number = decimal(c).try_cast("int")
    return F.when(number >= 0, number)


def tri_state(c: Column) -> Column:
    """Boolean of true / false; anything else is null."""
    return F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False)


def date_of(c: Column, *formats: str) -> Column:
    """Date by the first format that fits."""
    return F.coalesce(*(F.try_to_date(c, f) for f in formats or ("yyyy-MM-dd",)))


def german_date(c: Column) -> Column:
    """Date such as ``26 Mai 2026``; null for an unknown month, see ``unknown_month``."""
    return F.try_to_date(
        F.concat_ws(
            "-",
            F.regexp_extract(c, LONG_DATE, 3),
            F.lpad(_month_number(c).cast("string"), 2, "0"),
            F.lpad(F.regexp_extract(c, LONG_DATE, 1), 2, "0"),
        ),
        "yyyy-MM-dd",
    )


def unknown_month(c: Column) -> Column:
    """The month's name in a long date if no month is called so; a parse error of its row."""
    name = F.nullif(F.regexp_extract(c, LONG_DATE, 2), F.lit(""))
    return F.when(_month_number(c).isNull(), name)


def _month_number(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in GERMAN_MONTHS.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(c, LONG_DATE, 2))


def utc_time(c: Column) -> Column:
    """Timestamp of ISO text; without a zone it is UTC, the session's zone."""
    return F.try_to_timestamp(c)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def default_range(now: Column, months: int = 3) -> tuple[Column, Column]:
    """From the start of the day some months ago to the last minute of today."""
    start = F.date_trunc("day", F.add_months(now, -months))
    end = F.date_trunc("day", now) + F.expr("INTERVAL 23 HOURS 59 MINUTES")
    return start, end


def day_key(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 10)


def first_known(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum of a row's values; null only if all are."""
    known = reduce(lambda a, b: a | b, (c.isNotNull() for c in columns))
    return F.when(known, reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns)))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def confidence(score: Column, high: int = 4, medium: int = 2, low: int = 1) -> Column:
    return (
        F.when(score >= high, "high")
        .when(score >= medium, "medium")
        .when(score >= low, "low")
        .otherwise("unknown")
    )
