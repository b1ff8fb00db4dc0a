"""Rule relevance of texts: matched terms, evidence snippets, report fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import keys, numbers, text

# The vocabulary and thresholds of rule version rules-v1, in their order.
TERMS = (
    "HPAI",
    "H5N1",
    "H5N5",
    "Vogelgrippe",
    "Geflügelpest",
    "Gefluegelpest",
    "Aviäre Influenza",
    "Avian Influenza",
    "Newcastle",
    "Afrikanische Schweinepest",
    "ASP",
    "Lumpy Skin Disease",
    "Tierseuche",
    "Ausbruch",
    "Sperrzone",
    "Keulung",
    "Biosicherheit",
)
ACRONYMS = ("ASP", "HPAI", "H5N1", "H5N5")
MEASURES = (
    ("Sperrzone", "Sperrzonen"),
    ("Sperrzonen", "Sperrzonen"),
    ("keulen", "Keulung"),
    ("gekeult", "Keulung"),
    ("Keulung", "Keulung"),
    ("Stallpflicht", "Stallpflicht"),
    ("Impfung", "Impfung"),
    ("Monitoring", "Monitoring"),
    ("Biosicherheit", "Biosicherheit"),
    ("Handel", "Handel"),
    ("Export", "Export"),
)
# Patterns of disease names, the first that fits holds.
DISEASES = (
    (r"Vogelgrippe|Geflügelpest|Gefluegelpest|HPAI|Aviäre Influenza", "HPAI"),
    (r"Newcastle", "Newcastle Disease"),
    (r"Afrikanische Schweinepest|\bASP\b", "ASP"),
    (r"Lumpy Skin Disease|\bLSD\b", "LSD"),
)


@dataclass(frozen=True)
class Rules:
    """A vocabulary; the order of terms is the order of matches and snippets."""

    terms: Sequence[str] = TERMS
    acronyms: Sequence[str] = ACRONYMS
    measures: Sequence[tuple[str, str]] = MEASURES
    radius: int = 90
    max_snippets: int = 5
    version: str = "rules-v1"
    confidence: tuple[int, int, int] = field(default=(4, 2, 1))


def haystack(*parts: Column) -> Column:
    """Non-blank parts, a line each."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, "\n")


def term_hits(body: Column, rules: Rules) -> Column:
    """Array of (term, start, end): first place of every term that occurs, in order."""
    terms = F.array(*map(F.lit, rules.terms))
    return F.transform(
        text.first_places(body, rules.terms, rules.acronyms),
        lambda h: F.struct(
            F.get(terms, h["at"]).alias("term"), h["start"].alias("start"), h["end"].alias("end")
        ),
    )


def snippets(link: Column, body: Column, hits: Column, rules: Rules) -> Column:
    """Evidence of hits: text around each, those with a text seen before left out, then capped."""

    def evidence(h: Column) -> Column:
        start = F.greatest(F.lit(0), h["start"] - rules.radius)
        end = F.least(F.length(body), h["end"] + rules.radius)
        return F.struct(
            keys.snippet_id(link, h["term"], start).alias("snippet_id"),
            text.window_text(body, start, end).alias("text"),
            text.locator(start, end).alias("locator"),
            F.array(h["term"]).alias("matched_terms"),
        )

    every = F.transform(hits, evidence)
    texts = F.transform(every, lambda s: s["text"])
    first = F.filter(every, lambda s, i: F.array_position(texts, s["text"]) == i + 1)
    return F.slice(first, 1, rules.max_snippets)


def assess(articles: DataFrame, body: Column, link: str = "source_link", rules: Rules = Rules()) -> DataFrame:
    """Articles with matched_terms, relevance_score, is_relevant and evidence_snippets.

    The score counts all terms, also those whose snippet is left out. Texts are read once for
    all terms; the rules stand nowhere in a join.
    """
    hits = articles.withColumn("__body", body).withColumn("__hits", term_hits(F.col("__body"), rules))
    return (
        hits.withColumn("matched_terms", F.transform("__hits", lambda h: h["term"]))
        .withColumn("relevance_score", F.size("matched_terms"))
        .withColumn("is_relevant", F.col("relevance_score") > 0)
        .withColumn("evidence_snippets", snippets(F.col(link), F.col("__body"), F.col("__hits"), rules))
        .withColumn("filter_version", F.lit(rules.version))
        .drop("__body", "__hits")
    )


#: What a report keeps of its article, and as what.
ARTICLE_FIELDS = {
    "source_id": "source_id",
    "source_name": "source_name",
    "title": "source_document_title",
    "source_link": "source_link",
    "publication_date": "source_publication_date",
    "retrieved_at": "source_retrieved_at",
    "fulltext": "fulltext",
    "raw_html_path": "raw_html_path",
    "content_hash": "content_hash",
}


def report_text() -> Column:
    """What rules for reports read: title, description and full text, a line each."""
    return F.concat(
        "title", F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\n"), "fulltext"
    )


def extract_reports(
    articles: DataFrame, body: Column, rules: Rules = Rules(), text_of: Column | None = None
) -> DataFrame:
    """Report records of relevant articles (source_id, source_link, raw_html_path,
    publication_date, ...); what an article lacks is null.

    Terms are looked for in ``body``; subtype and measures in ``text_of``, by default the same.
    """
    full = body if text_of is None else text_of
    found = assess(articles.withColumns({"__text": body, "__full": full}), F.col("__text"), rules=rules)
    found = found.where("is_relevant")
    full = F.col("__full")
    report = keys.report_id(F.col("source_id"), F.col("raw_html_path"), F.col("source_link"))
    kept = [
        (F.col(c) if c in found.columns else F.lit(None).cast("string")).alias(name)
        for c, name in ARTICLE_FIELDS.items()
    ]
    return found.select(
        report.alias("report_id"),
        *kept,
        F.concat(F.lit("source_document:"), report).alias("source_document_id"),
        F.lit("candidate").alias("extraction_status"),
        F.lit("rules").alias("extraction_method"),
        F.lit(rules.version).alias("extraction_version"),
        numbers.confidence(F.col("relevance_score"), *rules.confidence).alias("extraction_confidence"),
        "evidence_snippets",
        F.col("relevance_score").alias("rule_relevance_score"),
        F.col("matched_terms").alias("rule_matched_terms"),
        text.subtype(full).alias("rule_disease_type"),
        text.labels_of_terms(full, rules.measures).alias("rule_control_measures"),
        keys.month_key(F.col("publication_date")).alias("situation_month"),
        text.evidence_text(F.col("evidence_snippets")).alias("raw_relevance_evidence"),
    )
