"""The staged pipeline: discover, parse, filter, extract, enrich, export.

Each stage reads tables and returns tables; a run hands them on in memory of the plan, and
``run_all`` writes what each stage leaves to a folder. Fetching needs a network and is left
to whoever fills the raw cache.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import keys, numbers
from tidewarden.operators import enrichment, incremental, relevance
from tidewarden.sinks import files
from tidewarden.sources import documents
from tidewarden.triples import emit
from tidewarden.triples.model import as_set


@dataclass
class Stages:
    """What a run leaves."""

    manifest: DataFrame
    articles: DataFrame
    parse_errors: DataFrame
    disease_articles: DataFrame
    reports: DataFrame
    enriched: DataFrame
    triples: DataFrame


def discover(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return found if existing is None else incremental.merge_manifest(found, existing)


def parse(raw: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(articles, parse errors) of raw pages (source_link, html)."""
    every = documents.articles(raw).withColumn("source_id", F.lit(source_id))
    month = numbers.unknown_month(F.col("date_text"))
    every = every.withColumn("error", F.coalesce("error", F.concat(F.lit("unknown month: "), month)))
    good = every.where("error is null").drop("error")
    articles = good.withColumn("publication_date", numbers.german_date(F.col("date_text"))).withColumn(
        "raw_html_path", keys.cache_file_name(F.col("source_link"))
    )
    return articles, every.where("error is not null").select("source_id", "source_link", "error")


def body_of() -> Column:
    return relevance.haystack(
        F.col("title"),
        F.coalesce("description", F.lit("")),
        F.array_join("keywords", " "),
        F.coalesce("category", F.lit("")),
        F.col("fulltext"),
    )


def filter_disease(articles: DataFrame, rules: relevance.Rules = relevance.Rules()) -> DataFrame:
    return relevance.assess(articles, body_of(), rules=rules).where("is_relevant")


def extract(articles: DataFrame, rules: relevance.Rules = relevance.Rules()) -> DataFrame:
    return relevance.extract_reports(articles, body_of(), rules, relevance.report_text())


def run(
    found: DataFrame,
    raw: DataFrame,
    source_id: str,
    extractor: enrichment.Extractor | None = None,
    fields: tuple[T.StructField, ...] = (),
    rules: relevance.Rules = relevance.Rules(),
) -> Stages:
    manifest = discover(found)
    articles, errors = parse(raw, source_id)
    reports = extract(articles, rules)
    for f in fields:
        if f.name not in reports.columns:
            reports = reports.withColumn(f.name, F.lit(None).cast(f.dataType))
    enriched = enrichment.enrich(reports, extractor, list(fields)) if extractor else reports
    return Stages(
        manifest,
        articles,
        errors,
        filter_disease(articles, rules),
        reports,
        enriched,
        as_set(emit.report_triples(enriched)),
    )


def run_all(spark: SparkSession, stages: Stages, folder: str) -> int:
    """Write what a run leaves; 0 if all went well, 1 without any report to export."""
    for name in ("manifest", "articles", "parse_errors", "disease_articles", "reports", "enriched"):
        files.json_lines(getattr(stages, name), f"{folder}/{name}")
    enriched = documents.json_lines(spark, f"{folder}/enriched", stages.enriched.schema)
    if not enriched.limit(1).count():
        return 1
    files.n_triples(stages.triples, f"{folder}/triples")
    files.csv(enriched, f"{folder}/reports_csv", sorted(enriched.columns))
    path = files.frontend_path(f"{folder}/reports_csv")
    files.csv(files.frontend_rows(enriched, ["source_id", "report_id"]), path, list(files.FRONTEND_COLUMNS))
    return 0
