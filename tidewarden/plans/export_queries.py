"""Queries of exports, views and graph patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import geo, keys, numbers, text
from tidewarden.operators import exports, joins, listing, scoring, stats
from tidewarden.plans.cases import CASES_SQL, SCORED_SQL, cases
from tidewarden.plans.catalog import query
from tidewarden.plans.pipeline_queries import TRIPLES_SQL, case_triples, documents
from tidewarden.sources import tabular
from tidewarden.triples import match

#: Notifications of events as text, with gaps and errors by rule; the same in SQL.
NOTIFIED_SQL = """n AS (SELECT event_id, CASE WHEN event_id % 41 <> 0 THEN 'R-' || event_id ELSE '' END AS ref,
    CASE WHEN event_id % 13 = 0 THEN 'NaN' ELSE event_type || ' in wild birds' END AS disease,
    CASE event_id % 5 WHEN 0 THEN 'Wild' WHEN 1 THEN ' captive ' ELSE '' END AS wildlife,
    CASE WHEN event_id % 2 = 0 THEN 'Poultry' ELSE 'N/A' END AS production, CASE WHEN event_id % 3 = 0 THEN 'Apiary' ELSE '' END AS unit,
    CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'NaN' END AS confirmed,
    CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS submitted,
    CASE WHEN event_id % 17 <> 0 THEN 45 + (user_id * 37 % 500) / 100e0 END AS lat,
    5 + (user_id * 91 % 700) / 100e0 AS lon, CASE WHEN event_id % 10 = 0 THEN -1 ELSE floor(value) END AS cases FROM events)"""


def notifications(spark, sf_dir):
    e = tabular.table(spark, f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    made = {
        "Reference": F.when(i % 41 != 0, F.concat(F.lit("R-"), i.cast("string"))).otherwise(""),
        "Disease name": F.when(i % 13 == 0, "NaN").otherwise(F.concat(F.col("event_type"), F.lit(" in wild birds"))),
        "Wildlife type 1": F.when(i % 5 == 0, "Wild").when(i % 5 == 1, " captive ").otherwise(""),
        "Production Type 1": F.when(i % 2 == 0, "Poultry").otherwise("N/A"),
        "Epidemiological unit": F.when(i % 3 == 0, "Apiary").otherwise(""),
        "Confirmation date": F.when(i % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("NaN"),
        "Submitted on": F.when(i % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(""),
        "Latitude": F.when(i % 17 != 0, comma(45 + (u * 37 % 500) / 100.0)),
        "Longitude": comma(5 + (u * 91 % 700) / 100.0),
        "Cases 1": F.when(i % 10 == 0, "-1").otherwise(comma(F.floor("value").cast("double"))),
        "Country/Territory": F.concat(F.lit("NATION_"), (u % 25).cast("string")),
    }
    blank = F.lit(None).cast("string")
    return e.select("event_id", *(made.get(c, blank).alias(c) for c in tabular.ADIS_COLUMNS))


@query(
    "adis_event_export",
    f"""WITH {NOTIFIED_SQL} SELECT nullif(ref, '') AS external_id, nullif(disease, 'NaN') AS disease,
    CASE WHEN wildlife = 'Wild' THEN 'wild' WHEN trim(wildlife) = 'captive' THEN 'captive' WHEN production = 'Poultry' THEN 'poultry'
      WHEN unit = 'Apiary' THEN 'apiary' END AS population,
    coalesce(nullif(confirmed, 'NaN'), nullif(submitted, '')) AS occurred_at, round(lat, 6) AS latitude,
    CASE WHEN cases >= 0 THEN CAST(cases AS BIGINT) END AS cases, CASE WHEN lat IS NOT NULL THEN round(2 * 6371.0088e0 * asin(sqrt(
      pow(sin(radians(lat - 46.948e0) / 2), 2) + cos(radians(46.948e0)) * cos(radians(lat)) * pow(sin(radians(lon - 7.4474e0) / 2), 2))), 1) END AS km
    FROM n""",
)
def adis_event_export(spark, sf_dir):
    found = exports.adis_events(notifications(spark, sf_dir))
    assert tuple(found.columns) == exports.EVENT_COLUMNS
    distance = geo.haversine_km(F.col("latitude"), F.col("longitude"), geo.BERN_EXPORT)
    return found.select(
        "external_id",
        "disease",
        "population",
        "occurred_at",
        "latitude",
        F.col("cases").cast("bigint").alias("cases"),
        F.round(distance, 1).alias("km"),
    )


@query(
    "conversion_counters",
    f"""WITH {NOTIFIED_SQL}, k AS (SELECT *, ref <> '' AS ok, CASE WHEN disease = '' THEN 'unknown' ELSE lower(replace(disease, ' ', '-')) END || '|' ||
      CASE WHEN confirmed <> 'NaN' THEN substr(confirmed, 1, 7) WHEN submitted <> '' THEN substr(submitted, 1, 7) ELSE 'unknown' END || '|' ||
      (SELECT user_id % 25 FROM events v WHERE v.event_id = n.event_id) AS sk FROM n)
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS skipped, CAST(count(*) FILTER (ok) AS BIGINT) AS events,
      CAST(count(*) FILTER (ok AND confirmed = 'NaN') AS BIGINT) AS fallback, CAST(count(*) FILTER (ok AND confirmed = 'NaN' AND submitted = '') AS BIGINT) AS undated,
      CAST(count(*) FILTER (ok AND lat IS NULL) AS BIGINT) AS missing_coordinates, CAST(count(DISTINCT sk) FILTER (ok) AS BIGINT) AS situations,
      CAST(count(DISTINCT disease) FILTER (ok) AS BIGINT) AS diseases, CAST(0 AS BIGINT) AS species FROM k""",
)
def conversion_counters(spark, sf_dir):
    return exports.conversion_counters(notifications(spark, sf_dir))


@query(
    "detail_rows",
    f"""WITH {CASES_SQL}, d AS (SELECT *, CASE WHEN lat IS NOT NULL THEN 2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(lat - 46.948e0) / 2), 2)
      + cos(radians(46.948e0)) * cos(radians(lat)) * pow(sin(radians(lon - 7.4474e0) / 2), 2)))) END AS km FROM cases)
    SELECT 'event:' || event_id AS id, coalesce(admin2, admin1, country) AS location, round(coalesce(km, 0), 6) AS distance,
      CASE WHEN km IS NULL OR exp(-km / 250e0) >= 0.8e0 THEN 'high' WHEN exp(-km / 250e0) >= 0.5e0 THEN 'medium' ELSE 'low' END AS priority FROM d""",
)
def detail_rows(spark, sf_dir):
    found = exports.detail_rows(cases(spark, sf_dir))
    return found.select("id", "location", F.round("distance", 6).alias("distance"), "priority")


@query(
    "report_view",
    """SELECT doc_id AS id, source, strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS "reportDate",
    CASE doc_id % 4 WHEN 0 THEN 'niedrig' WHEN 1 THEN 'mittel' WHEN 2 THEN 'hoch' END AS "relevanceLabel" FROM documents""",
)
def report_view(spark, sf_dir):
    i = F.col("doc_id")
    made = documents(spark, sf_dir).select(
        i.alias("id"),
        "source",
        *(F.lit(None).cast("string").alias(c) for c in ("title", "url", "teaser", "body", "admin_level_1", "admin_level_2", "admin_level_3")),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).alias("report_date"),
        F.lit(1).alias("relevance_score"),
        F.when(i % 4 == 0, "Low").when(i % 4 == 1, "medium").when(i % 4 == 2, "high").otherwise("?").alias("relevance"),
    )
    return exports.report_view(made).select("id", "source", "reportDate", "relevanceLabel")


@query(
    "disease_codes",
    f"""WITH {CASES_SQL}, l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Geflügelpest' WHEN 1 THEN 'BLAUZUNGENKRANKHEIT' WHEN 2 THEN 'ASP' WHEN 3 THEN '' ELSE disease END AS d FROM cases),
    k AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'HPAI' WHEN 1 THEN 'BT' WHEN 2 THEN 'ASP' WHEN 4 THEN d END AS code FROM l)
    SELECT event_id, code, CASE code WHEN 'HPAI' THEN '#f00' WHEN 'ASP' THEN '#00f' ELSE '#888' END AS colour FROM k""",
)
def disease_codes(spark, sf_dir):
    i = F.col("event_id")
    label = F.when(i % 5 == 0, "Geflügelpest").when(i % 5 == 1, "BLAUZUNGENKRANKHEIT").when(i % 5 == 2, "ASP").when(i % 5 == 3, "").otherwise(F.col("disease"))
    found = cases(spark, sf_dir).select("event_id", exports.disease_code(label).alias("code"))
    return found.withColumn("colour", exports.colour(F.col("code"), [("HPAI", "#f00"), ("ASP", "#00f")], "#888"))


@query(
    "dashboard_totals",
    """SELECT (SELECT count(*) FROM events) AS "outbreakEvents", (SELECT count(*) FROM documents) AS "paffReports", CAST(0 AS BIGINT) AS "outbreakSituations",
    CAST(0 AS BIGINT) AS "paffSituationStatements", CAST(0 AS BIGINT) AS "evidenceSnippets" """,
)
def dashboard_totals(spark, sf_dir):
    return exports.totals(spark.read.parquet(f"{sf_dir}/events.parquet"), documents(spark, sf_dir))


@query(
    "totals_by_kind",
    f"""WITH {CASES_SQL} SELECT CAST(count(*) FILTER (disease = 'click') AS BIGINT) AS n_click, CAST(count(*) FILTER (disease = 'view') AS BIGINT) AS n_view FROM cases""",
)
def totals_by_kind(spark, sf_dir):
    return exports.totals_by_kind(cases(spark, sf_dir), ["click", "view"])


@query(
    "graph_star_detail",
    f"""WITH {TRIPLES_SQL}, s AS (SELECT DISTINCT situation, situation_key FROM k WHERE situation IS NOT NULL)
    SELECT s.situation_key AS key, k.event_id AS ref, CAST(o.n AS BIGINT) AS n_shown FROM s JOIN k ON k.situation = s.situation
    JOIN (SELECT situation, count(*) AS n FROM k WHERE place IS NOT NULL GROUP BY 1) o ON o.situation = s.situation""",
)
def graph_star_detail(spark, sf_dir):
    """A situation's events beside each of its located ones, counted."""
    t = case_triples(spark, sf_dir)
    star = match.solve(
        t,
        [("?event", "ts:belongsToSituation", "?situation"), ("?situation", "ts:hasSituationKey", "?key"), ("?event", "ts:referenceId", "?ref")],
    )
    shown = match.solve(t, [("?other", "ts:belongsToSituation", "?situation"), ("?other", "ts:occursAt", "?loc")])
    counted = shown.groupBy("situation").agg(F.count("*").alias("n_shown"))
    return star.join(counted, "situation").select("key", F.col("ref").cast("bigint").alias("ref"), "n_shown")


@query(
    "graph_filter_values",
    f"WITH {TRIPLES_SQL} SELECT DISTINCT country AS value FROM k WHERE user_id % 25 < 20 AND place IS NOT NULL",
)
def graph_filter_values(spark, sf_dir):
    return match.distinct_values(case_triples(spark, sf_dir), "ts:adminLevel1Label")


@query(
    "measures_with_sentences",
    r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence,
      generate_subscripts(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
    t(word, measure) AS (VALUES ('clown', 'C'), ('moron', 'M'))
    SELECT doc_id, measure, arg_min(sentence, i) AS sentence FROM s JOIN t ON contains(lower(sentence), word) GROUP BY 1, 2""",
)
def measures_with_sentences(spark, sf_dir):
    found = text.measures_with_sentences(F.col("text"), [("clown", "C"), ("moron", "M")])
    return documents(spark, sf_dir).select("doc_id", F.inline(found))


@query(
    "priority_sort_top",
    f"""WITH {SCORED_SQL} SELECT event_id, CAST(priority AS BIGINT) AS priority FROM ranked ORDER BY priority, reported_at DESC NULLS LAST, event_id LIMIT 6""",
)
def priority_sort_top(spark, sf_dir):
    rows = scoring.scored(cases(spark, sf_dir))
    ordered = listing.sort(rows, [("priority", False), ("reported_at", True)], "event_id")
    return listing.page(ordered, 1, 6).select("event_id", F.col("priority").cast("bigint").alias("priority"))


@query(
    "report_sort",
    """SELECT doc_id FROM (SELECT documents.doc_id, quality AS score, CASE WHEN documents.doc_id % 3 <> 0 THEN CAST(DATE '2024-01-01' + CAST(documents.doc_id % 50 AS INTEGER) AS VARCHAR) END AS d
      FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id) ORDER BY coalesce(score, -1) DESC, coalesce(d, '') DESC, doc_id LIMIT 30""",
)
def report_sort(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("score"))
    i = F.col("doc_id")
    date = F.when(i % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 50).cast("int")))
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left").select(i.alias("report_id"), "score", date.alias("report_date"))
    return listing.sort_reports(rows).limit(30).select(F.col("report_id").alias("doc_id"))


@query(
    "planar_distance",
    f"""WITH {CASES_SQL} SELECT event_id, round(sqrt(pow((lat - 47e0) * 111e0, 2) + pow((lon - 8e0) * 111e0 * cos(radians(47e0)), 2)), 6) AS km FROM cases WHERE lat IS NOT NULL""",
)
def planar_distance(spark, sf_dir):
    km = geo.planar_km(F.col("lat"), F.col("lon"), 47.0, 8.0)
    return cases(spark, sf_dir).where("lat is not null").select("event_id", F.round(km, 6).alias("km"))


@query(
    "default_date_range",
    """SELECT o_orderkey, strftime(date_trunc('day', o_orderdate - INTERVAL 3 MONTH), '%Y-%m-%d %H:%M') AS first,
    strftime(date_trunc('day', o_orderdate) + INTERVAL 1439 MINUTE, '%Y-%m-%d %H:%M') AS last FROM orders""",
)
def default_date_range(spark, sf_dir):
    first, last = numbers.default_range(F.col("o_orderdate").cast("timestamp"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return tabular.table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", shown(first).alias("first"), shown(last).alias("last"))


@query(
    "cache_names",
    r"""WITH p AS (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/Seuchen_Lage: Äpfel.' || page_id || '//?x=/y' FROM pages),
    s AS (SELECT page_id, u, regexp_extract(rtrim(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), '[^/]*$') AS segment FROM p)
    SELECT page_id, substr(regexp_replace(segment, '[^\pL\pN_-]', '-', 'g'), 1, 120) || '-' || substr(sha256(u), 1, 12) || '.html' AS name FROM s""",
)
def cache_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    tail = F.concat(F.lit("/Seuchen_Lage: Äpfel."), F.col("page_id").cast("string"), F.lit("//?x=/y"))
    more = pages.withColumn("url", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail))
    return pages.unionByName(more).select("page_id", keys.cache_file_name(F.col("url")).alias("name"))


@query(
    "share_by_population",
    f"""WITH {CASES_SQL}, t AS (SELECT coalesce(population, '—') AS population, sum(value) AS total FROM cases GROUP BY 1)
    SELECT population, round(100 * total / sum(total) OVER ()) AS percent FROM t""",
)
def share_by_population(spark, sf_dir):
    return stats.share(stats.total_by(cases(spark, sf_dir), "population", "value"), "total").select("population", "percent")


@query(
    "peer_of_marker",
    f"""WITH {TRIPLES_SQL} SELECT b.event_id AS peer_id FROM k a JOIN k b ON a.situation_key = b.situation_key WHERE a.event_id = 7""",
)
def peer_of_marker(spark, sf_dir):
    from tidewarden.plans.pipeline_queries import keyed_cases

    return joins.peers(keyed_cases(spark, sf_dir)).where("event_id = 7").select("peer_id")
