"""Values by rank, without a buffer of all values: count in buckets, narrow, repeat.

A pass counts rows by bucket with partial sums and tells each bucket's least and greatest
value; the bucket that has a rank is cut anew in the next. The first pass takes signs and
binary exponents as buckets, as those of a range of doubles of any spread do; later ones
cut evenly between two values, at most a factor of two apart, so a few passes do. All ranks
narrow in the same passes. Buckets are monotone in the value, so rounding moves their edges
but never a value past another. When few rows are left to a rank, their values are counted.

Defined cases: nulls and NaN are no values; ranks of an empty column have no value; infinities
and both zeros are values like others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that a range is cut into.
CUTS = 4096
#: Rows of a range whose values are counted.
FEW = 4096


@dataclass(frozen=True)
class Range:
    """Values from least to greatest, n of them, with ``below`` lesser ones."""

    least: float
    greatest: float
    below: int
    n: int


def _by_exponent(x: Column) -> Column:
    """Sign and exponent as a number that does not fall as the value rises."""
    size = F.when(F.abs(x) == math.inf, 9999).otherwise(F.floor(F.log2(F.abs(x))) + 2000)
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size)


def _within(x: Column, r: Range) -> Column:
    width = r.greatest - r.least
    place = F.floor((x - F.lit(r.least)) / F.lit(width) * CUTS)
    return F.least(F.greatest(place, F.lit(0)), F.lit(CUTS - 1))


def _counted(rows: DataFrame, *by: Column) -> list:
    """Buckets in order, with how many rows each has and between which values."""
    names = [f"b{i}" for i in range(len(by))]
    keyed = rows.select("x", *(c.alias(n) for c, n in zip(by, names, strict=True)))
    found = keyed.groupBy(*names).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    return sorted(found.collect(), key=lambda r: r[: len(by)])


def values_at(df: DataFrame, column: str, ranks: Sequence[int] | None = None, at: Sequence[float] = ()) -> dict:
    """{rank: value} of the given ranks from 0, or of those that quantiles ``at`` fall between.

    With ``at`` the key ``n`` has the number of values.
    """
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ranges: list[Range] = []
    below = 0
    for _, n, least, greatest in _counted(rows, _by_exponent(F.col("x"))):
        ranges.append(Range(least + 0.0, greatest + 0.0, below, n))
        below += n
    if ranks is None:
        ranks = sorted({f(q * (below - 1)) for q in at if below for f in (math.floor, math.ceil)})
    found: dict = {"n": below}
    open_ranks = {k: next((r for r in ranges if r.below <= k < r.below + r.n), None) for k in ranks}
    while True:
        for k, r in list(open_ranks.items()):
            if r is None or r.least == r.greatest:
                found[k] = r and r.least
                del open_ranks[k]
        if not open_ranks:
            return found
        own = sorted(set(open_ranks.values()), key=lambda r: r.least)
        which, place = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, r in enumerate(own):
            here = F.col("x").between(r.least, r.greatest)
            which = F.when(here, i).otherwise(which)
            place = F.when(here, F.col("x") if r.n <= FEW else _within(F.col("x"), r).cast("double")).otherwise(place)
        marked = rows.where(which.isNotNull())
        narrowed: dict[int, list[Range]] = {}
        at_row: dict[int, int] = {}
        for i, _, n, least, greatest in _counted(marked, which, place):
            start = at_row.setdefault(i, own[i].below)
            narrowed.setdefault(i, []).append(Range(least + 0.0, greatest + 0.0, start, n))
            at_row[i] = start + n
        for k, r in open_ranks.items():
            parts = narrowed[own.index(r)]
            open_ranks[k] = next(p for p in parts if p.below <= k < p.below + p.n)


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float | None]:
    """Exact quantiles, between two values in proportion."""
    found = values_at(df, column, at=at)
    out = []
    for q in at:
        place = q * (found["n"] - 1)
        low, high = found.get(math.floor(place)), found.get(math.ceil(place))
        if low is None or high is None:
            out.append(None)
        else:
            out.append(low if low == high else low + (high - low) * (place - math.floor(place)))
    return out
