"""Checks of triples: shapes, links, coordinates, dates, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.filters import valid_coordinates, well_formed_key
from tidewarden.triples import match
from tidewarden.triples.model import A

#: Required predicates by class, fixed values.
SHAPES = {
    "ts:OutbreakSituation": (
        "ts:hasSituationKey",
        "ts:situationDisease",
        "ts:situationCountry",
        "ts:situationMonth",
    ),
    "ts:OutbreakEvent": ("ts:referenceId", "ts:hasDisease", "ts:occursAt", "ts:belongsToSituation"),
    "ts:EvidenceSnippet": ("ts:snippetText",),
    "ts:RelevanceAssessment": ("ts:hasRelevanceLevel",),
    "ts:SeverityAssessment": ("ts:hasSeverityLevel",),
    "ts:ReachAssessment": ("ts:hasReachLevel",),
    "ts:PaffReport": ("ts:paffDate", "ts:sourceDocumentTitle"),
    "ts:PaffSituationStatement": (
        "ts:describesSituation",
        "ts:hasEvidenceSnippet",
        "ts:hasExtractionConfidence",
        "ts:hasExtractionStatus",
        "ts:extractedFromSource",
    ),
}


#: Namespace of shapes.
SHACL = "http://www.w3.org/ns/shacl#"


def read_shapes(triples: DataFrame) -> dict[str, tuple[str, ...]]:
    """Required predicates of each class, from shapes that a Turtle reader read: properties with
    a path and a least count of one or more. ``sh`` is the short name of their namespace.

    Shapes are a vocabulary: a row for each property of each class comes to the driver.
    """
    patterns = [("?shape", "sh:targetClass", "?class"), ("?shape", "sh:property", "?p"), ("?p", "sh:path", "?path"), ("?p", "sh:minCount", "?n")]
    found = match.solve(triples.where(F.startswith("p", F.lit("sh:"))), patterns)
    rows = found.where(F.col("n").try_cast("int") >= 1).select("class", "path").distinct().collect()
    return {c: tuple(sorted(r.path for r in rows if r["class"] == c)) for c in sorted({r["class"] for r in rows})}


def shape_violations(triples: DataFrame, shapes: dict[str, tuple[str, ...]] = SHAPES) -> DataFrame:
    """(node, class, missing): required predicates that a node of a class lacks.

    One aggregate by node gathers its classes and predicates; vocabularies bound both sets.
    """
    wanted = F.array(
        *(
            F.struct(F.lit(c).alias("class"), F.lit(p).alias("missing"))
            for c, required in shapes.items()
            for p in required
        )
    )
    nodes = triples.groupBy(F.col("s").alias("node")).agg(
        F.collect_set(F.when(F.col("p") == A, F.col("o"))).alias("classes"),
        F.collect_set("p").alias("predicates"),
    )
    lacking = F.filter(
        wanted,
        lambda w: F.array_contains("classes", w["class"]) & ~F.array_contains("predicates", w["missing"]),
    )
    return nodes.select("node", F.inline(lacking))


def coordinate_buckets(located: DataFrame) -> DataFrame:
    """Rows with valid, missing and invalid coordinates."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ok = both & valid_coordinates(F.col("lat"), F.col("lon"))
    return located.agg(
        F.sum(ok.cast("bigint")).alias("n_valid"),
        F.sum((~both).cast("bigint")).alias("n_missing"),
        F.sum((both & ~ok).cast("bigint")).alias("n_invalid"),
    )


def date_sources(events: DataFrame, source: str = "date_source") -> DataFrame:
    return events.groupBy(source).agg(F.count("*").alias("n"))


def presence(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For (raw, normalised) columns: how often each is known."""
    entries = []
    aggregates = []
    for i, (raw, normal) in enumerate(pairs):
        aggregates += [F.count(raw).alias(f"r{i}"), F.count(normal).alias(f"n{i}")]
        entries.append(
            F.struct(F.lit(raw).alias("field"), F.col(f"r{i}").alias("n_raw"), F.col(f"n{i}").alias("n_normal"))
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def marker_readiness(events: DataFrame, situations: DataFrame, key: str = "situation_key") -> DataFrame:
    """Events with coordinates, and those of them whose situation exists."""
    known = situations.select(F.col(key).alias("__key")).distinct()
    marked = events.join(known, F.col(key) == F.col("__key"), "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return marked.agg(
        F.sum(located.cast("bigint")).alias("n_markers"),
        F.sum((located & F.col("__key").isNotNull()).cast("bigint")).alias("n_resolved"),
    )


def malformed_keys(situations: DataFrame, key: str = "situation_key") -> DataFrame:
    return situations.where(~F.coalesce(well_formed_key(F.col(key)), F.lit(False)))


def report(triples: DataFrame) -> DataFrame:
    """One row of counts for a report on events, situations, source rows and links."""
    of = lambda c: F.count_distinct(F.when((F.col("p") == A) & (F.col("o") == c), F.col("s")))
    return triples.agg(
        of("ts:OutbreakEvent").alias("n_events"),
        of("ts:OutbreakSituation").alias("n_situations"),
        of("ts:SourceRow").alias("n_source_rows"),
        of("skos:Concept").alias("n_concepts"),
        F.count_distinct(F.when(F.col("p") == "ts:belongsToSituation", F.col("s"))).alias("n_linked"),
    )
