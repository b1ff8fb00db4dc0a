"""Graph patterns over triples: basic patterns, optional parts, paths, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.triples.model import A

Pattern = tuple[str, str, str]


def is_variable(term: str) -> bool:
    return term.startswith("?")


def solve(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Solutions of a basic graph pattern: a column for each variable.

    Each pattern is a filtered scan of the triples; patterns join on what they share, in
    the order given, the next connected one first.
    """
    left = list(patterns)
    out = _scan(triples, left.pop(0))
    while left:
        at = next((i for i, p in enumerate(left) if set(_names(p)) & set(out.columns)), None)
        if at is None:
            raise ValueError(f"patterns {left} share no variable with those before")
        part = _scan(triples, left.pop(at))
        out = out.join(part, [c for c in out.columns if c in part.columns])
    return out


def optional(solutions: DataFrame, triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Solutions with what an optional pattern adds; null where it has no solution."""
    part = solve(triples, patterns)
    return solutions.join(part, [c for c in solutions.columns if c in part.columns], "left")


def optional_into(
    solutions: DataFrame, triples: DataFrame, subject: str, predicates: Sequence[str], name: str
) -> DataFrame:
    """One variable bound by the first of several optional predicates that has a value.

    Once it is bound, a later pattern can only match the same value, which adds nothing; so a
    subject meets the values of its first predicate alone, each once.
    """
    found = triples.where(F.col("p").isin(*predicates)).select(
        F.col("s").alias("__subject"),
        F.array_position(F.array(*map(F.lit, predicates)), F.col("p")).alias("__at"),
        F.col("o").alias(name),
    )
    first = F.min("__at").over(W.partitionBy("__subject"))
    found = found.withColumn("__first", first).where("__at = __first").select("__subject", name).distinct()
    return solutions.join(found, F.col(subject) == F.col("__subject"), "left").drop("__subject")


def path(triples: DataFrame, subject: str, steps: Sequence[str], end: str) -> DataFrame:
    """(subject, end) along predicates; one with a leading ``^`` is walked backwards."""
    out, here = None, subject
    for i, step in enumerate(steps):
        there = end if i == len(steps) - 1 else f"__{i}"
        ends = (there, here) if step.startswith("^") else (here, there)
        part = _scan(triples, (f"?{ends[0]}", step.lstrip("^"), f"?{ends[1]}"))
        out = part if out is None else out.join(part, here)
        here = there
    return out.select(subject, end)


def count_by_class(triples: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """(class, n): distinct nodes of each class."""
    typed = triples.where(F.col("p") == A)
    if classes:
        typed = typed.where(F.col("o").isin(*classes))
    return typed.groupBy(F.col("o").alias("class")).agg(F.count_distinct("s").alias("n"))


def distinct_values(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("o").alias("value")).distinct()


def _names(p: Pattern) -> list[str]:
    return [t[1:] for t in p if is_variable(t)]


def _scan(triples: DataFrame, p: Pattern) -> DataFrame:
    found = triples
    for term, c in zip(p, ("s", "p", "o"), strict=True):
        if not is_variable(term):
            found = found.where(F.col(c) == term)
    named: dict[str, str] = {}
    for term, c in zip(p, ("s", "p", "o"), strict=True):
        if is_variable(term):
            if term[1:] in named:
                found = found.where(F.col(c) == F.col(named[term[1:]]))
            else:
                named[term[1:]] = c
    return found.select(*(F.col(c).alias(n) for n, c in named.items()))
