"""Queries of profiles: missing values, distributions, keys, tables of counts, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import numbers, text
from tidewarden.operators import filters, incremental, joins, profiling, stats
from tidewarden.plans.cases import CASES_SQL, cases
from tidewarden.plans.catalog import query
from tidewarden.sources import tabular

#: Orders with gaps by rule, as a table with three dates; the same in SQL.
ORDERS_SQL = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS confirmed,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 11 AS INTEGER) END AS suspected,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 13 AS INTEGER) AS submitted FROM orders)"""


def dated_orders(spark, sf_dir):
    o = tabular.table(spark, f"{sf_dir}/orders.parquet")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.when(k % 7 != 0, day).alias("confirmed"),
        F.when(k % 5 != 0, F.date_sub(day, (k % 11).cast("int"))).alias("suspected"),
        F.date_add(day, (k % 13).cast("int")).alias("submitted"),
    )


@query(
    "top_counts_missing",
    f"""WITH {CASES_SQL} SELECT coalesce(admin1, 'Missing') AS admin1, CAST(count(*) AS BIGINT) AS n FROM cases
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def top_counts_missing(spark, sf_dir):
    return stats.top_counts(cases(spark, sf_dir), "admin1", 5)


@query(
    "crosstab_top",
    f"""WITH {CASES_SQL}, t AS (SELECT country FROM cases GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6)
    SELECT country, CAST(count(*) FILTER (disease = 'click') AS BIGINT) AS click,
      CAST(count(*) FILTER (disease = 'view') AS BIGINT) AS view
    FROM cases WHERE country IN (SELECT country FROM t) GROUP BY 1""",
)
def crosstab_top(spark, sf_dir):
    rows = stats.top_rows(cases(spark, sf_dir), "country", 6)
    return stats.crosstab(rows, "country", "disease", ["click", "view"])


@query(
    "crosstab_nulls",
    f"""WITH {CASES_SQL} SELECT disease, population, CAST(count(*) AS BIGINT) AS n FROM cases GROUP BY 1, 2""",
)
def crosstab_nulls(spark, sf_dir):
    return stats.crosstab_long(cases(spark, sf_dir), "disease", "population")


@query(
    "monthly_counts",
    f"""WITH {ORDERS_SQL} SELECT strftime(date_trunc('month', confirmed), '%Y-%m-%d') AS month,
      CAST(count(*) AS BIGINT) AS n FROM o WHERE confirmed IS NOT NULL GROUP BY 1""",
)
def monthly_counts(spark, sf_dir):
    found = stats.monthly(dated_orders(spark, sf_dir), "confirmed")
    return found.withColumn("month", F.col("month").cast("string"))


@query(
    "monthly_by_top_category",
    f"""WITH {ORDERS_SQL}, t AS (SELECT o_orderpriority AS p FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
    SELECT strftime(date_trunc('month', confirmed), '%Y-%m-%d') AS month, o_orderpriority, CAST(count(*) AS BIGINT) AS n
    FROM o WHERE confirmed IS NOT NULL AND o_orderpriority IN (SELECT p FROM t) GROUP BY 1, 2""",
)
def monthly_by_top_category(spark, sf_dir):
    rows = stats.top_rows(dated_orders(spark, sf_dir), "o_orderpriority", 2)
    found = stats.monthly(rows, "confirmed", "o_orderpriority")
    return found.withColumn("month", F.col("month").cast("string"))


@query(
    "schema_profile",
    f"""WITH {CASES_SQL}, n AS (SELECT count(*) AS n FROM cases)
    {" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing, "
        f"round(100e0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS missing_percent, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM cases"
        for c in ("event_id", "disease", "population", "lat", "country", "admin1")
    )}""",
)
def schema_profile(spark, sf_dir):
    rows = profiling.existing(
        cases(spark, sf_dir), ["event_id", "disease", "population", "lat", "nowhere", "country", "admin1"]
    )
    return profiling.schema_profile(rows).drop("kind")


@query(
    "mostly_missing",
    f"""WITH {CASES_SQL}, c AS (SELECT count(*) AS n, count(population) AS p, count(admin2) AS a FROM cases)
    SELECT 'admin2' AS column_name, round(100e0 * (n - a) / n, 2) AS missing_percent FROM c""",
)
def mostly_missing(spark, sf_dir):
    profile = profiling.schema_profile(profiling.existing(cases(spark, sf_dir), ["population", "admin2"]))
    return filters.mostly_missing(profile, 30.0).select("column_name", "missing_percent")


@query(
    "date_coverage",
    f"""WITH {ORDERS_SQL} SELECT 'confirmed' AS column_name, CAST(min(confirmed) AS VARCHAR) AS first_date,
      CAST(max(confirmed) AS VARCHAR) AS last_date, CAST(count(*) FILTER (confirmed IS NULL) AS BIGINT) AS missing FROM o
    UNION ALL SELECT 'suspected', CAST(min(suspected) AS VARCHAR), CAST(max(suspected) AS VARCHAR),
      CAST(count(*) FILTER (suspected IS NULL) AS BIGINT) FROM o""",
)
def date_coverage(spark, sf_dir):
    found = profiling.date_coverage(dated_orders(spark, sf_dir), ["confirmed", "suspected"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(
    "overview_row",
    f"""WITH {ORDERS_SQL} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_o_custkey,
      CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_o_orderstatus, CAST(min(confirmed) AS VARCHAR) AS first_date,
      CAST(max(confirmed) AS VARCHAR) AS last_date FROM o""",
)
def overview_row(spark, sf_dir):
    found = profiling.overview(dated_orders(spark, sf_dir), ["o_custkey", "o_orderstatus"], "confirmed")
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(
    "describe_percentiles",
    """SELECT CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
      min(value) AS least, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50,
      round(quantile_cont(value, 0.95), 6) AS q95, max(value) AS greatest FROM events""",
)
def describe_percentiles(spark, sf_dir):
    d = profiling.describe(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", (0.05, 0.5, 0.95))
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q05", "q50", "q95")})


@query(
    "quantile_trim",
    """WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events)
    SELECT event_id FROM events, q WHERE value BETWEEN a AND b""",
)
def quantile_trim(spark, sf_dir):
    return filters.quantile_trim(spark.read.parquet(f"{sf_dir}/events.parquet"), "value").select("event_id")


@query(
    "duplicate_flags",
    f"""WITH {CASES_SQL} SELECT event_id, row_number() OVER (PARTITION BY disease, admin1, admin2 ORDER BY event_id) > 1
      AS is_duplicate FROM cases""",
)
def duplicate_flags(spark, sf_dir):
    found = incremental.duplicated(cases(spark, sf_dir), ["disease", "admin1", "admin2"], [F.col("event_id")])
    return found.select("event_id", "is_duplicate")


@query(
    "duplicate_count",
    f"""WITH {CASES_SQL}, g AS (SELECT disease, admin1, admin2, count(*) AS n FROM cases GROUP BY ALL)
    SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM g""",
)
def duplicate_count(spark, sf_dir):
    return profiling.duplicates(cases(spark, sf_dir), ["disease", "admin1", "admin2"])


@query(
    "key_checks",
    """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(text) AS BIGINT) AS n_known,
      CAST(count(DISTINCT text) AS BIGINT) AS n_unique, CAST(count(text) - count(DISTINCT text) AS BIGINT) AS n_repeated
    FROM documents""",
)
def key_checks(spark, sf_dir):
    return profiling.key_check(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


@query(
    "rowwise_sum_min_count",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN round(
      CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 * value ELSE 0 END, 6) END AS total
    FROM events""",
)
def rowwise_sum_min_count(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    total = numbers.row_sum([F.when(i % 2 == 0, v), F.when(i % 3 == 0, 2 * v)])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(total, 6).alias("total"))


@query(
    "delay_days",
    f"""WITH {ORDERS_SQL} SELECT o_orderkey, CAST(confirmed - suspected AS BIGINT) AS to_confirm,
      CAST(submitted - confirmed AS BIGINT) AS to_submit FROM o""",
)
def delay_days(spark, sf_dir):
    return dated_orders(spark, sf_dir).select(
        "o_orderkey",
        numbers.days_between(F.col("confirmed"), F.col("suspected")).cast("bigint").alias("to_confirm"),
        numbers.days_between(F.col("submitted"), F.col("confirmed")).cast("bigint").alias("to_submit"),
    )


@query(
    "longest_delays",
    f"""WITH {ORDERS_SQL} SELECT o_orderkey, CAST(submitted - suspected AS BIGINT) AS delay FROM o
    WHERE suspected IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 25""",
)
def longest_delays(spark, sf_dir):
    delay = numbers.days_between(F.col("submitted"), F.col("suspected")).cast("bigint").alias("delay")
    rows = dated_orders(spark, sf_dir).where("suspected is not null").select("o_orderkey", delay)
    return stats.top(rows, "delay", 25, "o_orderkey")


@query(
    "date_fallback_audit",
    f"""WITH {ORDERS_SQL} SELECT CASE WHEN confirmed IS NOT NULL THEN 'confirmation' WHEN suspected IS NOT NULL THEN 'suspicion'
      ELSE 'submitted' END AS date_source, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1""",
)
def date_fallback_audit(spark, sf_dir):
    from tidewarden.triples.quality import date_sources

    source = F.when(F.col("confirmed").isNotNull(), "confirmation").when(
        F.col("suspected").isNotNull(), "suspicion"
    ).otherwise("submitted")
    return date_sources(dated_orders(spark, sf_dir).withColumn("date_source", source))


@query(
    "array_term_counts",
    r"""WITH w AS (SELECT unnest(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS element FROM documents)
    SELECT element, CAST(count(*) AS BIGINT) AS n FROM w WHERE element <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""",
)
def array_term_counts(spark, sf_dir):
    words = F.split(text.collapse_space(F.col("text")), " ").alias("words")
    return stats.element_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select(words), "words", 40)


@query(
    "list_length_stats",
    r"""WITH w AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents)
    SELECT CAST(min(n) AS BIGINT) AS min_length, CAST(median(n) AS DOUBLE) AS median_length,
      CAST(max(n) AS BIGINT) AS max_length, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty_rows FROM w""",
)
def list_length_stats(spark, sf_dir):
    lines = F.when(F.col("doc_id") % 10 != 0, F.split("text", "\n")).alias("lines")
    found = stats.list_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet").select(lines), "lines")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("min_length", "max_length")})


@query(
    "text_metrics",
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
      ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS BIGINT) AS words FROM documents""",
)
def text_metrics(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        text.word_count(F.col("text")).cast("bigint").alias("words"),
    )


@query(
    "shortest_texts",
    "SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY length(text), doc_id LIMIT 20",
)
def shortest_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return profiling.text_extremes(docs, "text", 20, "doc_id", longest=False).select("doc_id")


@query(
    "vector_metrics",
    """WITH v AS (SELECT CASE WHEN vec_id % 9 = 0 THEN 0 ELSE len(embedding) END AS n FROM embeddings)
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (n = 0) AS BIGINT) AS n_empty,
      CAST(min(n) FILTER (n > 0) AS BIGINT) AS min_size, CAST(median(n) FILTER (n > 0) AS DOUBLE) AS median_size,
      CAST(max(n) FILTER (n > 0) AS BIGINT) AS max_size FROM v""",
)
def vector_metrics(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    some = v.select(F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"))
    found = profiling.vector_sizes(some, "embedding")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("min_size", "max_size")})


@query(
    "pipeline_funnel",
    """SELECT 'documents' AS stage, CAST(count(*) AS BIGINT) AS n_rows FROM documents
    UNION ALL SELECT 'labels', CAST(count(*) AS BIGINT) FROM labels
    UNION ALL SELECT 'toxic', CAST(count(*) AS BIGINT) FROM labels WHERE toxic = 1""",
)
def pipeline_funnel(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return profiling.funnel([("documents", docs), ("labels", labels), ("toxic", labels.where("toxic = 1"))])


@query(
    "missing_reports",
    """SELECT doc_id, 'unlabelled' AS artifact FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def missing_reports(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return profiling.labelled_union(
        [
            ("unlabelled", incremental.missing_from(docs, labels, "doc_id")),
            ("unknown", incremental.missing_from(labels, docs, "doc_id")),
        ]
    )


@query(
    "nearest_concept_cosine",
    f"""WITH c(i, k) AS (VALUES {", ".join(f"({i}, {i * 7 + 1})" for i in range(5))}),
    v AS (SELECT i, 'concept-' || k AS name, list_transform(range(1, 65), lambda j: ((j * k) % 13 - 6)::DOUBLE) AS w FROM c)
    SELECT vec_id, name AS concept, round(list_cosine_similarity(embedding::DOUBLE[], w), 6) AS similarity FROM embeddings, v
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], w) DESC, i) = 1""",
)
def nearest_concept_cosine(spark, sf_dir):
    concepts = [
        (f"concept-{i * 7 + 1}", [float((j * (i * 7 + 1)) % 13 - 6) for j in range(1, 65)]) for i in range(5)
    ]
    found = joins.nearest_concept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), concepts)
    return found.select("vec_id", "concept", F.round("similarity", 6).alias("similarity"))


@query("seeded_sample", "SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return profiling.sample(spark.read.parquet(f"{sf_dir}/events.parquet"), 50, "event_id").select("event_id")
