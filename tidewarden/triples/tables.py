"""Graphs as tables: terms as numbers, a folder for each predicate, rows sorted by subject.

Written once, read by many patterns. Triples are de-duplicated once; each different term gets a
number that its place in the written dictionary gives it; predicates, which are as many as
a vocabulary has, are folders, so a pattern reads its own predicates alone. Of each predicate
it is kept whether a subject has one value at most.

A star (patterns that share their subject) is one aggregate by subject: values of such
predicates are an aggregate's greatest, others are lists that are then dealt out to rows. A star
of n patterns takes one exchange of numbers where joins take n.

Defined cases: an empty graph has no predicates, and any star over it no rows; a required
predicate that the graph lacks gives no rows, an optional one nulls; repeated triples are one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.triples.model import COLUMNS

#: Predicates of a graph, at most: they are folders.
MAX_PREDICATES = 10_000
TERM = ("value", "kind", "datatype")
ROW_SCHEMA = "s bigint, o bigint"


def star(
    triples: DataFrame,
    subject: str,
    required: Mapping[str, str],
    optional: Mapping[str, str] | None = None,
    fixed: Mapping[str, object] | None = None,
    single: Sequence[str] = (),
) -> DataFrame:
    """Solutions of patterns that share their subject, over distinct (s, p, o): a column for the
    subject and for each variable of ``required`` and ``optional`` ({predicate: variable}).

    ``fixed`` has predicates with the object they must have; ``single`` those of which a subject
    has one object at most.
    """
    optional, fixed = dict(optional or {}), dict(fixed or {})
    values = {**required, **optional}
    own = triples.where(F.col("p").isin(*{*values, *fixed}))

    def of(p: str) -> Column:
        return F.when(F.col("p") == p, F.col("o"))

    columns = [F.max((F.col("p") == p) & (F.col("o") == o)).alias(f"__fixed{i}") for i, (p, o) in enumerate(fixed.items())]
    for p, name in values.items():
        columns.append((F.max(of(p)) if p in single else F.collect_list(of(p))).alias(name))
    if not columns:
        raise ValueError("a star needs a pattern")
    found = own.groupBy(F.col("s").alias(subject)).agg(*columns)
    for i in range(len(fixed)):
        found = found.where(F.col(f"__fixed{i}")).drop(f"__fixed{i}")
    for p, name in required.items():
        found = found.where(F.col(name).isNotNull() if p in single else F.size(name) > 0)
    for p, name in values.items():
        if p not in single:
            found = found.withColumn(name, F.explode_outer(name))
    return found


class GraphTables:
    """A written graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/predicates").collect()
        self.places = {r.predicate: r.place for r in rows}
        self.single = {r.predicate for r in rows if r.single}

    @classmethod
    def write(cls, triples: DataFrame, path: str) -> GraphTables:
        spark = triples.sparkSession
        triples.select(*COLUMNS).dropDuplicates(["s", "p", "o", "kind", "datatype"]).write.parquet(f"{path}/set")
        every = spark.read.parquet(f"{path}/set")
        subject = F.struct(F.col("s").alias("value"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"))
        value = F.struct(F.col("o").alias("value"), "kind", "datatype")
        terms = every.select(F.explode(F.array(subject, value)).alias("t")).select("t.*").distinct()
        # A term's number is its place among the rows as they are written.
        terms.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")

        def number(name: str, kind: Column, datatype: Column, as_: str) -> tuple[DataFrame, Column]:
            side = terms.select(*(F.col(c).alias(f"__{as_}_{c}") for c in TERM), F.col("id").alias(as_))
            same = (F.col(name) == F.col(f"__{as_}_value")) & (kind == F.col(f"__{as_}_kind"))
            return side, same & datatype.eqNullSafe(F.col(f"__{as_}_datatype"))

        counts = every.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.max("n").alias("n"))
        found = sorted((r.p, r.n == 1) for r in counts.limit(MAX_PREDICATES + 1).collect())
        if len(found) > MAX_PREDICATES:
            raise ValueError(f"more than {MAX_PREDICATES} predicates")
        schema = "predicate string, place int, single boolean"
        spark.createDataFrame([(p, i, one) for i, (p, one) in enumerate(found)], schema).coalesce(1).write.parquet(
            f"{path}/predicates"
        )
        places = spark.read.parquet(f"{path}/predicates")
        s_side, s_same = number("s", F.lit("iri"), F.lit(None).cast("string"), "s_id")
        o_side, o_same = number("o", F.col("kind"), F.col("datatype"), "o_id")
        numbered = every.join(s_side, s_same).join(o_side, o_same).join(F.broadcast(places), F.col("p") == F.col("predicate"))
        dealt = numbered.select("place", F.col("s_id").alias("s"), F.col("o_id").alias("o")).repartition("s")
        dealt.sortWithinPartitions("place", "s", "o").write.partitionBy("place").parquet(f"{path}/rows")
        return cls(spark, path)

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def rows(self, predicates: Sequence[str]) -> DataFrame:
        """(s, p, o) of some predicates, p as text."""
        frames = [
            self.spark.read.schema(ROW_SCHEMA).parquet(f"{self.path}/rows/place={self.places[p]}").select("s", F.lit(p).alias("p"), "o")
            for p in sorted({*predicates})
            if p in self.places
        ]
        if not frames:
            return self.spark.createDataFrame([], "s bigint, p string, o bigint")
        return reduce(DataFrame.unionByName, frames)

    def id_of(self, value: str, kind: str = "iri") -> int | None:
        row = self.terms().where((F.col("value") == value) & (F.col("kind") == kind)).select("id").first()
        return row and row.id

    def star(
        self,
        subject: str,
        required: Mapping[str, str],
        optional: Mapping[str, str] | None = None,
        fixed: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """Solutions as numbers; ``fixed`` objects are addresses."""
        ids = {p: self.id_of(o) for p, o in (fixed or {}).items()}
        rows = self.rows([*required, *(optional or {}), *ids])
        if None in ids.values():
            rows = rows.limit(0)
        return star(rows, subject, required, optional, {p: F.lit(i) for p, i in ids.items()}, sorted(self.single))

    def decode(self, solutions: DataFrame, *columns: str) -> DataFrame:
        """Solutions with the texts of some columns' terms."""
        out = solutions
        for c in columns:
            side = self.terms().select(F.col("id").alias(f"__{c}"), F.col("value").alias(f"__{c}_value"))
            out = out.join(side, F.col(c) == F.col(f"__{c}"), "left").withColumn(c, F.col(f"__{c}_value")).drop(f"__{c}", f"__{c}_value")
        return out
