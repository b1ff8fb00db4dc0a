"""Triples of a row, as data: (subject, predicate, object) columns in one array per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A = "rdf:type"
COLUMNS = ("s", "p", "o", "kind", "datatype", "graph")


def link(s: Column, p: str, o: Column, graph: str = "data") -> Column:
    """A triple between two nodes; a null end makes none."""
    return _triple(s, p, o, "iri", None, graph)


def literal(s: Column, p: str, o: Column, datatype: str | None = None, graph: str = "data") -> Column:
    """A triple with a value; null or blank makes none."""
    return _triple(s, p, F.nullif(o.cast("string"), F.lit("")), "literal", datatype, graph)


def is_a(s: Column, *classes: str, graph: str = "data") -> list[Column]:
    return [link(s, A, F.lit(c), graph) for c in classes]


def _triple(s: Column, p: str, o: Column, kind: str, datatype: str | None, graph: str) -> Column:
    return F.when(
        s.isNotNull() & o.isNotNull(),
        F.struct(
            s.alias("s"),
            F.lit(p).alias("p"),
            o.alias("o"),
            F.lit(kind).alias("kind"),
            F.lit(datatype).cast("string").alias("datatype"),
            F.lit(graph).alias("graph"),
        ),
    )


def emit(df: DataFrame, triples: Sequence[Column], nested: Sequence[Column] = ()) -> DataFrame:
    """All triples of all rows; ``nested`` are arrays of triples. Not yet a set."""
    every = F.array(*triples)
    if nested:
        every = F.concat(every, *nested)
    kept = F.filter(every, lambda t: t.isNotNull())
    return df.select(F.explode(kept).alias("t")).select("t.*")


def as_set(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates()


def union(*graphs: DataFrame) -> DataFrame:
    """Triples of several graphs, each once; those of graphs without languages have none."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return as_set(out)
