"""Queries of text, key and date functions and of small operators, over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import geo, keys, numbers, text
from tidewarden.operators import enrichment, filters, incremental, relevance, stats
from tidewarden.plans.cases import CASES_SQL, cases
from tidewarden.plans.catalog import query, table
from tidewarden.plans.pipeline_queries import RULES, SITUATION_SQL, TERMS_SQL, documents, keyed_cases
from tidewarden.sinks import files
from tidewarden.sources import documents as sources
from tidewarden.sources import tabular
from tidewarden.streaming import events as streams
from tidewarden.triples import match


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "underscore_slugs",
    "SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents",
)
def underscore_slugs(spark, sf_dir):
    plain = F.replace("text", F.lit("ß"), F.lit("ss"))
    return documents(spark, sf_dir).select("doc_id", text.underscore_slug(plain).alias("slug"))


@query(
    "keyword_split",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords
    FROM documents""",
)
def keyword_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.split_list(F.col("text")), "|").alias("keywords"))


@query(
    "query_file_names",
    """SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'doc-' || page_id || '.pdf' ELSE regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') END AS name
    FROM pages""",
)
def query_file_names(spark, sf_dir):
    i = F.col("page_id")
    named = F.concat(F.lit("https://e.org/get?x=1&filename=doc-"), i.cast("string"), F.lit(".pdf&y=2"))
    url = F.when(i % 2 == 1, named).otherwise("https://e.org/get")
    return pages(spark, sf_dir).select("page_id", keys.query_file_name(url, F.col("url")).alias("name"))


@query(
    "concept_iris",
    """SELECT event_id, 'ts:disease_' || replace(event_type, '-', '_') || '_outbreak' AS iri, replace(event_type, '-', '_') || '_outbreak' AS local FROM events""",
)
def concept_iris(spark, sf_dir):
    found = keys.concept_iri("disease", F.concat("event_type", F.lit(" Outbreak!")))
    return events(spark, sf_dir).select("event_id", found.alias("iri"), keys.local_name(found).alias("local"))


@query(
    "padded_ids",
    "SELECT event_id, 'E-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, substr(sha1(event_type || event_id), 1, 12) AS row_id FROM events",
)
def padded_ids(spark, sf_dir):
    row = keys.source_row_id(F.col("event_type"), F.col("event_id"))
    return events(spark, sf_dir).select("event_id", text.padded_id("E-", F.col("event_id"), 9).alias("id"), row.alias("row_id"))


@query(
    "unfenced_answers",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"id": ' || doc_id || '}' WHEN 1 THEN '{"id": ' || doc_id || '}' END AS answer,
    CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id AS VARCHAR) END AS id FROM documents""",
)
def unfenced_answers(spark, sf_dir):
    i = F.col("doc_id")
    body = F.concat(F.lit('{"id": '), i.cast("string"), F.lit("}"))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))
    answer = enrichment.parse_answer(F.when(i % 3 == 0, fenced).when(i % 3 == 1, body).otherwise("[1, 2]"))
    return documents(spark, sf_dir).select("doc_id", answer.alias("answer"), F.get_json_object(answer, "$.id").alias("id"))


@query(
    "display_times",
    "SELECT event_id, strftime(ts, '%d.%m.%y · %H:%M') AS shown FROM events",
)
def display_times(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", text.display_time(F.col("ts")).alias("shown"))


@query(
    "image_urls",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://e.org/img/' || page_id || '.png' WHEN 1 THEN 'https://cdn.org/' || page_id || '.png' END AS image,
    'Tom & Ann no. ' || page_id AS plain FROM pages""",
)
def image_urls(spark, sf_dir):
    i = F.col("page_id")
    number = i.cast("string")
    src = F.when(i % 3 == 0, F.concat(F.lit("/img/"), number)).when(i % 3 == 1, F.concat(F.lit("https://cdn.org/"), number))
    page = F.coalesce(F.concat(F.lit('<p>x</p><img class="a" src="'), src, F.lit('.png"><img src="/other.png">')), F.lit("<p>none</p>"))
    fragment = F.concat(F.lit("<p>Tom &amp; <b>Ann</b>\n no.&nbsp; "), number, F.lit("</p>"))
    return pages(spark, sf_dir).select(
        "page_id", text.image_url(page, "https://e.org/").alias("image"), sources.plain_text(fragment).alias("plain")
    )


@query(
    "labels_and_blocks",
    """SELECT doc_id, lang AS label, '# ' || source || chr(10) || chr(10) || lang AS markdown, source || '; ' || lang AS evidence FROM documents""",
)
def labels_and_blocks(spark, sf_dir):
    parts = F.array(*(F.struct(F.col(c).alias("text")) for c in ("source", "lang")))
    return documents(spark, sf_dir).select(
        "doc_id",
        text.strip_label(F.concat(F.lit("Bild: "), "lang", F.lit(" Quelle: ")), "Bild:", "Quelle:").alias("label"),
        text.markdown([F.concat(F.lit("# "), "source"), F.lit(" "), F.lit(None).cast("string"), F.col("lang")]).alias("markdown"),
        text.evidence_text(parts).alias("evidence"),
    )


@query(
    "record_prompts",
    """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}' AS record,
    'Extract.' || chr(10) || chr(10) || '{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}' AS prompt
    FROM documents""",
)
def record_prompts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return docs.select(
        "doc_id",
        text.json_text(F.struct("doc_id", "lang")).alias("record"),
        enrichment.prompt(docs, " Extract.\n", ["lang", "doc_id"]).alias("prompt"),
    )


@query(
    "semantic_overlay",
    "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'xx' WHEN 2 THEN lang END AS lang, source FROM documents",
)
def semantic_overlay(spark, sf_dir):
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, '{"lang": null}').when(i % 3 == 1, '{"lang": "xx", "source": "z"}').otherwise("{}")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", answer.alias("answer"))
    return incremental.overlay(docs, "answer", [T.StructField("lang", T.StringType())])


_MONTHS = "['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember']"


@query(
    "german_dates",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 7 = 0 THEN 'Brumaire' END AS unknown FROM events""",
)
def german_dates(spark, sf_dir):
    i, ts = F.col("event_id"), F.col("ts")
    names = [m for m in numbers.GERMAN_MONTHS if m != "Maerz"]
    name = F.get(F.array(*map(F.lit, names)), F.month(ts) - 1)
    name = F.when(i % 7 == 0, "Brumaire").when((i % 2 == 0) & (name == "März"), "Maerz").otherwise(name)
    date = F.concat_ws(" ", F.lit("Stand:"), F.dayofmonth(ts).cast("string"), name, F.year(ts).cast("string"), F.lit("Bern"))
    return events(spark, sf_dir).select(
        "event_id", numbers.german_date(date).alias("day"), numbers.unknown_month(date).alias("unknown")
    )


@query(
    "dates_in_formats",
    """SELECT event_id, CAST(ts AS DATE) AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds,
    CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m') END AS month, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""",
)
def dates_in_formats(spark, sf_dir):
    i, ts = F.col("event_id"), F.col("ts")
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")
    day = F.when(i % 3 == 0, F.date_format(ts, formats[0])).when(i % 3 == 1, F.date_format(ts, formats[1])).otherwise(F.date_format(ts, formats[2]))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    month = F.when(i % 5 != 0, F.date_format(ts, "yyyy-MM-dd")).otherwise("unsure")
    flag = F.when(i % 3 == 0, " TRUE").when(i % 3 == 1, "False").otherwise("maybe")
    return events(spark, sf_dir).select(
        "event_id",
        numbers.date_of(day, *formats).alias("day"),
        F.unix_seconds(numbers.utc_time(iso)).alias("seconds"),
        keys.month_of_text(month).alias("month"),
        numbers.tri_state(flag).alias("flag"),
    )


@query(
    "report_ids",
    r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'padi_web:' || page_id ELSE 'news:' || regexp_extract(rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), '[^/]*$') END AS report_id
    FROM pages""",
)
def report_ids(spark, sf_dir):
    i = F.col("page_id")
    source = F.when(i % 2 == 0, "padi_web").otherwise("news")
    raw = F.concat(F.lit("data/raw/"), i.cast("string"), F.lit(".json"))
    return pages(spark, sf_dir).select("page_id", keys.report_id(source, raw, F.col("url")).alias("report_id"))


@query(
    "malformed_rows",
    f"""WITH {CASES_SQL} SELECT lat IS NOT NULL AND disease IS NOT NULL AS ok, CAST(count(*) AS BIGINT) AS n FROM cases GROUP BY 1""",
)
def malformed_rows(spark, sf_dir):
    good, bad = filters.malformed(cases(spark, sf_dir), ["lat", "disease"])
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(ok).alias("ok"), "n") for ok, df in ((True, good), (False, bad))]
    return counted[0].unionByName(counted[1])


@query(
    "well_formed_keys",
    f"""WITH {SITUATION_SQL} SELECT event_id, event_id % 4 <> 0 AND event_id % 3 <> 0 AS ok FROM keyed""",
)
def well_formed_keys(spark, sf_dir):
    i, key = F.col("event_id"), F.col("situation_key")
    moved = F.when(i % 4 == 0, F.upper(key)).when(i % 3 == 0, F.concat(key, F.lit("|x"))).otherwise(key)
    return keyed_cases(spark, sf_dir).select("event_id", filters.well_formed_key(moved).alias("ok"))


@query(
    "document_links",
    "SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id % 3 = 0",
)
def document_links(spark, sf_dir):
    i = F.col("page_id")
    rows = pages(spark, sf_dir).select(
        "page_id",
        F.concat("url", F.when(i % 4 == 0, "/a.PDF").when(i % 2 == 0, "/document/download/1").otherwise("")).alias("href"),
        F.when(i % 3 == 0, "Report on HPAI").alias("text"),
    )
    return filters.document_links(rows).select("page_id")


@query(
    "frontend_export",
    """SELECT CAST(row_number() OVER (ORDER BY source, doc_id) AS VARCHAR) AS id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title, 'https://e.org/' || doc_id AS url,
    '' AS teaser, text AS body, CASE WHEN doc_id % 2 = 0 THEN '2026-05-01' ELSE '2026-06-02' END AS report_date, 'A' AS admin_level_1, '' AS admin_level_2, '' AS admin_level_3,
    CAST(n_chars AS VARCHAR) AS relevance_score, 'high' AS relevance_score_string, '' AS distance_km, '2026-05-03' AS created_at, '2026-05-03' AS updated_at FROM documents""",
)
def frontend_export(spark, sf_dir):
    i = F.col("doc_id")
    reports = documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("source_id"),
        F.when(i % 3 != 0, F.col("lang")).alias("source_document_title"),
        F.concat(F.lit("https://e.org/"), i.cast("string")).alias("source_link"),
        F.col("text").alias("fulltext"),
        F.when(i % 2 == 0, F.lit("2026-05-01").cast("date")).alias("source_publication_date"),
        F.lit("2026-06-02").cast("date").alias("confirmation_date"),
        F.lit("A").alias("administrative_division_level_1"),
        F.col("n_chars").alias("rule_relevance_score"),
        F.lit("high").alias("relevance_level"),
        F.lit("2026-05-03").alias("source_retrieved_at"),
    )
    return files.frontend_rows(reports, ["source_id", "doc_id"])


@query(
    "report_fields",
    f"""WITH {TERMS_SQL} SELECT 'news:' || doc_id AS report_id, 'news' AS source_id, 'News' AS source_name, 'source_document:news:' || doc_id AS source_document_id,
    'T' || doc_id AS source_document_title, 'https://e.org/n/' || doc_id AS source_link, CAST('2026-05-26' AS DATE) AS source_publication_date, '2026-05-27' AS source_retrieved_at,
    text AS fulltext, 'raw/' || doc_id || '.html' AS raw_html_path, sha256(text) AS content_hash, 'rules' AS extraction_method, 'rules-v1' AS extraction_version,
    'candidate' AS extraction_status, CASE WHEN len(terms) >= 4 THEN 'high' WHEN len(terms) >= 2 THEN 'medium' ELSE 'low' END AS extraction_confidence,
    CAST(len(terms) AS BIGINT) AS rule_relevance_score, array_to_string(terms, ',') AS rule_matched_terms, '2026-05' AS situation_month FROM t WHERE len(terms) > 0""",
)
def report_fields(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    articles = documents(spark, sf_dir).select(
        F.lit("news").alias("source_id"),
        F.lit("News").alias("source_name"),
        F.concat(F.lit("T"), number).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("https://e.org/n/"), number).alias("source_link"),
        F.lit("2026-05-26").cast("date").alias("publication_date"),
        F.lit("2026-05-27").alias("retrieved_at"),
        F.col("text").alias("fulltext"),
        F.concat(F.lit("raw/"), number, F.lit(".html")).alias("raw_html_path"),
        keys.content_hash(F.col("text")).alias("content_hash"),
    )
    found = relevance.extract_reports(articles, F.col("fulltext"), RULES, relevance.report_text())
    return found.select(
        *(c for c in found.columns if c not in LISTS),
        F.array_join("rule_matched_terms", ",").alias("rule_matched_terms"),
    ).withColumn("rule_relevance_score", F.col("rule_relevance_score").cast("bigint"))


#: Columns of reports that other queries compare.
LISTS = ("evidence_snippets", "rule_matched_terms", "rule_disease_type", "rule_control_measures", "raw_relevance_evidence")


@query(
    "disease_names",
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Lage zu LSD, ' WHEN 1 THEN 'GEFLUEGELPEST ' WHEN 2 THEN 'newcastle ' WHEN 3 THEN '(ASP) ' WHEN 4 THEN 'Lumpy skin disease ' ELSE '' END || text AS t
      FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)Vogelgrippe|Geflügelpest|Gefluegelpest|HPAI|Aviäre Influenza') THEN 'HPAI' WHEN regexp_matches(t, '(?i)Newcastle') THEN 'Newcastle Disease'
      WHEN regexp_matches(t, '(?i)Afrikanische Schweinepest|(^|[^\pL\pN_])ASP([^\pL\pN_]|$)') THEN 'ASP'
      WHEN regexp_matches(t, '(?i)Lumpy Skin Disease|(^|[^\pL\pN_])LSD([^\pL\pN_]|$)') THEN 'LSD' END AS disease FROM d""",
)
def disease_names(spark, sf_dir):
    begin = ("Lage zu LSD, ", "GEFLUEGELPEST ", "newcastle ", "(ASP) ", "Lumpy skin disease ", "")
    first = F.get(F.array(*map(F.lit, begin)), (F.col("doc_id") % 6).cast("int"))
    return documents(spark, sf_dir).select(
        "doc_id", text.cascade(F.concat(first, "text"), relevance.DISEASES).alias("disease")
    )


@query(
    "research_titles",
    """WITH t AS (SELECT doc_id, 'title-' || doc_id AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'other-' || doc_id FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT doc_id, 'url-' || doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0)
    SELECT CAST(d.doc_id AS VARCHAR) AS doc, v AS research FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
)
def research_titles(spark, sf_dir):
    i = F.col("doc_id")
    docs = documents(spark, sf_dir).select("doc_id", i.cast("string").alias("doc"))

    def named(kind, predicate, when):
        value = F.concat(F.lit(f"{kind}-"), "doc")
        return docs.where(when).select(F.col("doc").alias("s"), F.lit(predicate).alias("p"), value.alias("o"))

    triples = named("title", "ts:title", i % 2 == 0).unionByName(named("other", "ts:title", i % 10 == 0))
    triples = triples.unionByName(named("url", "ts:url", i % 3 == 0))
    return match.optional_into(docs.select("doc"), triples, "doc", ["ts:title", "ts:url"], "research")


def answer_of(record: dict) -> dict:
    """An extractor for the query below: fails on some records, answers wrongly on others."""
    number = int(record["report_id"])
    if number % 5 == 0:
        raise ValueError(f"bad {number}")
    return [number] if number % 7 == 0 else {"species": f"s{number}", "lang": "ignored"}


ENRICHED_SQL = """e AS (SELECT CAST(doc_id AS VARCHAR) AS report_id, lang, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 's' || doc_id END AS species,
    CASE WHEN doc_id % 5 = 0 THEN 'extraction: ValueError: bad ' || doc_id WHEN doc_id % 7 = 0 THEN 'extraction: TypeError: extractor must return a JSON object' END AS _error FROM documents)"""


def enriched(spark, sf_dir):
    reports = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("report_id"), "lang", F.lit(None).cast("string").alias("species")
    )
    return enrichment.enrich(reports, answer_of, [T.StructField("species", T.StringType())])


@query("enrichment_errors", f"WITH {ENRICHED_SQL} SELECT * FROM e")
def enrichment_errors(spark, sf_dir):
    return enriched(spark, sf_dir).select("report_id", "lang", "species", "_error")


@query(
    "enrichment_error_count",
    f"WITH {ENRICHED_SQL} SELECT CAST(count(_error) AS BIGINT) AS n_errors, CAST(count(*) AS BIGINT) AS n_rows FROM e",
)
def enrichment_error_count(spark, sf_dir):
    return enrichment.error_count(enriched(spark, sf_dir))


@query(
    "relevance_context",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 0.5e0 WHEN event_id % 11 = 0 THEN 1e0 ELSE exp(-value / 250e0) END AS relevance FROM events""",
)
def relevance_context(spark, sf_dir):
    i = F.col("event_id")
    stored, distance = F.when(i % 3 == 0, 0.5), F.when(i % 11 != 0, F.col("value"))
    return events(spark, sf_dir).select("event_id", geo.relevance(stored, i % 2 == 0, distance, 250.0).alias("relevance"))


@query("clean_headers", "SELECT r_regionkey, r_name FROM region")
def clean_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return tabular.clean_header(rows.toDF(" r_regionkey ;", "﻿r_name; "))


@query(
    "look_back_window",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY",
)
def look_back_window(spark, sf_dir):
    return streams.look_back(events(spark, sf_dir), "ts", 7, dt.datetime(2024, 1, 20, 12)).select("event_id")


@query("value_counts", f"WITH {CASES_SQL} SELECT population, CAST(count(*) AS BIGINT) AS n FROM cases GROUP BY 1")
def value_counts(spark, sf_dir):
    return stats.counts(cases(spark, sf_dir), "population")


@query(
    "head_and_rest",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= 300 AS head, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents",
)
def head_and_rest(spark, sf_dir):
    """The first of a manifest are worked on, the rest stay; both are put together again."""
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    head, rest = incremental.head_split(docs, 300, "doc_id")
    both = incremental.union_sources(head.withColumn("head", F.lit(True)), rest.withColumn("head", F.lit(False)))
    even = F.col("doc_id") % 2 == 0
    return incremental.recombine(both.where(even), both.where(~even).drop("lang"), "doc_id").select("doc_id", "head", "lang")


@query("ids_without_label", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ids_without_label(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return incremental.missing_from(docs, table(spark, sf_dir, "labels"), "doc_id")
