"""Queries of dashboards: filters, options, scores, statistics, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import geo
from tidewarden.operators import filters, joins, listing, scoring, stats
from tidewarden.plans.cases import CASES_SQL, SCORED_SQL, cases
from tidewarden.plans.catalog import query

WAYPOINTS = ((0.0, 10.0), (0.25, 40.0), (0.25, 41.0), (0.6, 20.0), (1.0, 80.0))


@query(
    "flagship_situation_rollup",
    f"""WITH {SCORED_SQL}
    SELECT disease, strftime(reported_at, '%Y-%m') AS month, CAST(priority AS BIGINT) AS priority,
      CAST(count(*) AS BIGINT) AS n_cases, round(sum(score), 6) AS relevance,
      round(avg(distance_km), 6) AS mean_distance
    FROM ranked GROUP BY 1, 2, 3""",
)
def flagship_situation_rollup(spark, sf_dir):
    return (
        scoring.scored(cases(spark, sf_dir))
        .groupBy(
            "disease",
            F.date_format("reported_at", "yyyy-MM").alias("month"),
            F.col("priority").cast("bigint").alias("priority"),
        )
        .agg(
            F.count("*").alias("n_cases"),
            F.round(F.sum("score"), 6).alias("relevance"),
            F.round(F.avg("distance_km"), 6).alias("mean_distance"),
        )
    )


@query(
    "filter_multiselect",
    f"""WITH {CASES_SQL} SELECT event_id, disease, population FROM cases
    WHERE disease IN ('click', 'view') AND population IN ('poultry', 'captive')""",
)
def filter_multiselect(spark, sf_dir):
    chosen = {"disease": ["click", "view"], "population": ["poultry", "captive"], "country": []}
    return filters.multi_select(cases(spark, sf_dir), chosen).select("event_id", "disease", "population")


@query(
    "filter_date_null_pass",
    f"""WITH {CASES_SQL} SELECT event_id FROM cases WHERE reported_at IS NULL
    OR reported_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'""",
)
def filter_date_null_pass(spark, sf_dir):
    return filters.date_range(
        cases(spark, sf_dir), "reported_at", "2024-01-05 00:00:00", "2024-01-09 12:00:00"
    ).select("event_id")


@query(
    "filter_day_range",
    f"""WITH {CASES_SQL} SELECT event_id FROM cases WHERE reported_at IS NULL
    OR strftime(reported_at, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-04'""",
)
def filter_day_range(spark, sf_dir):
    return filters.day_range(cases(spark, sf_dir), "reported_at", "2024-01-03", "2024-01-04").select("event_id")


@query(
    "search_contains",
    f"""WITH {CASES_SQL} SELECT event_id FROM cases
    WHERE contains(lower(concat_ws(' ', disease, population, country, admin1, admin2)), 'poultry nation_7')""",
)
def search_contains(spark, sf_dir):
    columns = ["disease", "population", "country", "admin1", "admin2"]
    return filters.search(cases(spark, sf_dir), columns, " Poultry NATION_7 ").select("event_id")


@query(
    "filter_optional_equal",
    f"WITH {CASES_SQL} SELECT event_id FROM cases WHERE country = 'NATION_3' AND disease = 'view'",
)
def filter_optional_equal(spark, sf_dir):
    return filters.optional_equal(
        cases(spark, sf_dir), country="NATION_3", disease="view", admin1=None
    ).select("event_id")


@query(
    "filter_pattern_mask",
    f"""WITH {CASES_SQL} SELECT event_id FROM cases
    WHERE regexp_matches(coalesce(disease, ''), '(?i)PURCH|err') OR regexp_matches(coalesce(population, ''), '(?i)wild')""",
)
def filter_pattern_mask(spark, sf_dir):
    mask = filters.pattern_mask({"disease": "PURCH|err", "population": "wild"})
    return cases(spark, sf_dir).where(mask).select("event_id")


@query(
    "filter_any_known",
    f"WITH {CASES_SQL} SELECT event_id FROM cases WHERE population IS NOT NULL OR lat IS NOT NULL",
)
def filter_any_known(spark, sf_dir):
    return cases(spark, sf_dir).where(filters.any_known(["population", "lat"])).select("event_id")


@query(
    "filter_complete",
    f"""WITH {CASES_SQL} SELECT event_id FROM cases
    WHERE disease IS NOT NULL AND admin1 IS NOT NULL AND admin2 IS NOT NULL""",
)
def filter_complete(spark, sf_dir):
    return cases(spark, sf_dir).where(filters.complete(["disease", "admin1", "admin2"])).select("event_id")


@query(
    "options_distinct",
    f"WITH {CASES_SQL} SELECT DISTINCT admin1 FROM cases WHERE admin1 IS NOT NULL",
)
def options_distinct(spark, sf_dir):
    return listing.options(cases(spark, sf_dir), "admin1", "de")


@query(
    "paged_sort",
    f"""WITH {SCORED_SQL} SELECT event_id, CAST(priority AS BIGINT) AS priority, round(score, 6) AS score
    FROM ranked ORDER BY round(score, 6) DESC, event_id LIMIT 100 OFFSET 200""",
)
def paged_sort(spark, sf_dir):
    rows = scoring.scored(cases(spark, sf_dir)).select(
        "event_id", F.col("priority").cast("bigint").alias("priority"), F.round("score", 6).alias("score")
    )
    return listing.page(listing.sort(rows, [("score", True)], "event_id"), 3)


@query(
    "haversine_decay",
    f"""WITH {SCORED_SQL} SELECT event_id, round(distance_km, 6) AS distance_km, round(near, 6) AS near
    FROM near""",
)
def haversine_decay(spark, sf_dir):
    d = geo.haversine_km(F.col("lat"), F.col("lon"), geo.BERN_SCORE)
    return cases(spark, sf_dir).select(
        "event_id",
        F.round(d, 6).alias("distance_km"),
        F.round(geo.proximity(d, 250.0), 6).alias("near"),
    )


@query(
    "grid_density_3x3",
    f"""WITH {SCORED_SQL} SELECT CAST(r AS BIGINT) AS cell_lat, CAST(c AS BIGINT) AS cell_lon,
    CAST(neighbours AS BIGINT) AS neighbours FROM around""",
)
def grid_density_3x3(spark, sf_dir):
    cells = scoring.cell_counts(cases(spark, sf_dir))
    found = scoring.neighbour_counts(cells).join(cells, ["cell_lat", "cell_lon"], "left_semi")
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in ("cell_lat", "cell_lon", "neighbours")))


@query(
    "score_priority",
    f"""WITH {SCORED_SQL} SELECT event_id, CAST(neighbours AS BIGINT) AS neighbours, round(score, 6) AS score,
    CAST(priority AS BIGINT) AS priority FROM ranked""",
)
def score_priority(spark, sf_dir):
    return scoring.scored(cases(spark, sf_dir)).select(
        "event_id",
        F.coalesce("neighbours", F.lit(0)).cast("bigint").alias("neighbours"),
        F.round("score", 6).alias("score"),
        F.col("priority").cast("bigint").alias("priority"),
    )


@query(
    "stats_by_type",
    f"""WITH {CASES_SQL} SELECT coalesce(disease, '—') AS disease, round(sum(value), 6) AS total
    FROM cases GROUP BY 1""",
)
def stats_by_type(spark, sf_dir):
    return stats.total_by(cases(spark, sf_dir), "disease", "value").select("disease", F.round("total", 6).alias("total"))


@query(
    "stats_fixed_domain",
    f"""WITH {CASES_SQL} SELECT population, round(sum(value), 6) AS total FROM cases
    WHERE population IN ('wild birds', 'poultry', 'apiary') GROUP BY 1 HAVING sum(value) > 0""",
)
def stats_fixed_domain(spark, sf_dir):
    return stats.total_by_domain(
        cases(spark, sf_dir), "population", "value", ["wild birds", "poultry", "apiary"]
    ).select("population", F.round("total", 6).alias("total"))


@query(
    "top_regions",
    f"""WITH {CASES_SQL} SELECT admin1, round(sum(value), 6) AS total FROM cases WHERE admin1 IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""",
)
def top_regions(spark, sf_dir):
    totals = stats.total_by(cases(spark, sf_dir), "admin1", "value", None)
    return stats.top(totals.withColumn("total", F.round("total", 6)), "total", 4, "admin1")


@query(
    "daily_gap_filled",
    f"""WITH {CASES_SQL}, s AS (SELECT CAST(reported_at AS DATE) AS day, sum(value) AS t FROM cases
      WHERE reported_at IS NOT NULL AND day(reported_at) % 3 <> 0 GROUP BY 1),
    d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
    SELECT strftime(d.day, '%Y-%m-%d') AS day, round(coalesce(t, 0), 6) AS total
    FROM d LEFT JOIN s ON d.day = s.day""",
)
def daily_gap_filled(spark, sf_dir):
    known = F.when(F.day("reported_at") % 3 != 0, F.col("reported_at"))  # days without a date
    rows = cases(spark, sf_dir).withColumn("reported_at", known)
    return stats.daily(rows, "reported_at", "value").select(
        F.col("day").cast("string").alias("day"), F.round("total", 6).alias("total")
    )


@query(
    "share_of_total",
    f"""WITH {CASES_SQL}, t AS (SELECT disease, sum(value) AS total FROM cases WHERE disease IS NOT NULL GROUP BY 1)
    SELECT disease, round(100 * total / sum(total) OVER ()) AS percent FROM t""",
)
def share_of_total(spark, sf_dir):
    totals = stats.total_by(cases(spark, sf_dir), "disease", "value", None)
    return stats.share(totals, "total").select("disease", "percent")


@query(
    "risk_level",
    f"""WITH {CASES_SQL} SELECT country, CASE WHEN count(*) > 400 THEN 'high' ELSE
      CASE WHEN count(*) // 70 > 6 THEN 'high' WHEN count(*) // 70 > 2 THEN 'medium' ELSE 'low' END END AS risk
    FROM cases GROUP BY 1""",
)
def risk_level(spark, sf_dir):
    n = stats.counts(cases(spark, sf_dir), "country")
    many = F.when(F.col("n") > 400, "high").otherwise(stats.risk_level(F.floor(F.col("n") / 70)))
    return n.select("country", many.alias("risk"))


@query(
    "scale_floor",
    f"WITH {CASES_SQL} SELECT greatest(1e0, max(value)) AS scale FROM cases WHERE value < 0.5e0",
)
def scale_floor(spark, sf_dir):
    return stats.scale_max(cases(spark, sf_dir).where("value < 0.5"), "value")


@query(
    "reach_rule",
    f"""WITH {CASES_SQL} SELECT disease || '|' || strftime(reported_at, '%Y-%m-%d') || '|' || country AS situation,
      CASE WHEN count(DISTINCT admin1) > 1 THEN 'national'
        WHEN count(DISTINCT admin1) = 1 AND count(DISTINCT admin2) > 1 THEN 'regional'
        WHEN count(DISTINCT admin1) = 1 AND count(DISTINCT admin2) = 1 THEN 'local' ELSE 'unknown' END AS reach
    FROM cases WHERE disease IS NOT NULL AND reported_at IS NOT NULL GROUP BY 1""",
)
def reach_rule(spark, sf_dir):
    rows = cases(spark, sf_dir).where("disease is not null and reported_at is not null")
    day = F.date_format("reported_at", "yyyy-MM-dd")
    keyed = rows.withColumn("situation", F.concat_ws("|", "disease", day, "country"))
    return stats.reach(keyed, "situation", ("country", "admin1", "admin2"))


@query(
    "playback_steps",
    f"""WITH {CASES_SQL}, s AS (SELECT CAST(floor(epoch(reported_at) / 21600) AS BIGINT) AS step, count(*) AS n
      FROM cases WHERE reported_at IS NOT NULL GROUP BY 1)
    SELECT step, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS shown FROM s""",
)
def playback_steps(spark, sf_dir):
    return scoring.playback(cases(spark, sf_dir))


@query(
    "timeline_reveal",
    f"""WITH {CASES_SQL}, e AS (SELECT min(epoch_us(reported_at)) AS a, max(epoch_us(reported_at)) AS b FROM cases)
    SELECT event_id, round((epoch_us(reported_at) - a) / CAST(b - a AS DOUBLE), 6) AS t FROM cases, e
    WHERE (epoch_us(reported_at) - a) / CAST(b - a AS DOUBLE) <= 0.4e0""",
)
def timeline_reveal(spark, sf_dir):
    return scoring.timeline(cases(spark, sf_dir)).where("t <= 0.4").select("event_id", F.round("t", 6).alias("t"))


@query(
    "center_score",
    f"""WITH {SCORED_SQL}, s AS (SELECT CAST(round(100 * avg(score)) AS BIGINT) AS centre_score FROM ranked)
    SELECT centre_score, CASE WHEN centre_score >= 66 THEN 'high' WHEN centre_score >= 33 THEN 'medium'
      ELSE 'low' END AS band FROM s""",
)
def center_score(spark, sf_dir):
    found = scoring.centre_score(scoring.scored(cases(spark, sf_dir)))
    return found.withColumn("centre_score", F.col("centre_score").cast("bigint"))


@query(
    "kernel_heat",
    f"""WITH {CASES_SQL}, c AS (SELECT CAST(round(lat / 0.5e0) AS BIGINT) AS r, CAST(round(lon / 0.5e0) AS BIGINT) AS k,
      sum(value) AS w FROM cases WHERE lat IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT unnest(generate_series(-3, 3)) AS a), p AS (SELECT o.a, q.a AS b FROM o, o q)
    SELECT r + a AS cell_lat, k + b AS cell_lon, round(sum(w * exp(-(pow(a * 0.5e0, 2) + pow(b * 0.5e0, 2)) / 2)), 4) AS heat
    FROM c, p GROUP BY 1, 2""",
)
def kernel_heat(spark, sf_dir):
    found = scoring.heat(cases(spark, sf_dir).withColumn("weight", F.col("value")))
    return found.select(
        F.col("cell_lat").cast("bigint").alias("cell_lat"),
        F.col("cell_lon").cast("bigint").alias("cell_lon"),
        F.round("heat", 4).alias("heat"),
    )


@query(
    "mercator",
    f"""WITH {CASES_SQL} SELECT event_id, round(lon * (20037508.342789244e0 / 180), 3) AS x,
    round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137e0, 3) AS y FROM cases WHERE lat IS NOT NULL""",
)
def mercator(spark, sf_dir):
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    located = filters.has_coordinates(cases(spark, sf_dir))
    return located.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "nearest_waypoint",
    f"""WITH {CASES_SQL}, w(i, pos, v) AS (VALUES {", ".join(f"({i}, {a}e0, {v}e0)" for i, (a, v) in enumerate(WAYPOINTS))}),
    p AS (SELECT event_id, (event_id % 1000) / 1000e0 AS t FROM cases)
    SELECT event_id, CAST(i AS BIGINT) AS waypoint, v AS waypoint_value FROM p, w
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(t - pos), i) = 1""",
)
def nearest_waypoint(spark, sf_dir):
    points = cases(spark, sf_dir).select("event_id", ((F.col("event_id") % 1000) / 1000.0).alias("t"))
    found = joins.nearest(points, WAYPOINTS)
    return found.select("event_id", F.col("waypoint").cast("bigint").alias("waypoint"), "waypoint_value")


@query(
    "piecewise_interpolation",
    f"""WITH {CASES_SQL}, p AS (SELECT event_id, (event_id % 1000) / 1000e0 AS t FROM cases)
    SELECT event_id, round(CASE WHEN t <= 0.25e0 THEN 10 + 30 * t / 0.25e0
      WHEN t <= 0.6e0 THEN 41 - 21 * (t - 0.25e0) / 0.35e0 ELSE 20 + 60 * (t - 0.6e0) / 0.4e0 END, 6) AS path_value
    FROM p""",
)
def piecewise_interpolation(spark, sf_dir):
    points = cases(spark, sf_dir).select("event_id", ((F.col("event_id") % 1000) / 1000.0).alias("t"))
    return joins.piecewise(points, WAYPOINTS).select("event_id", F.round("path_value", 6).alias("path_value"))


@query(
    "relevance_label_map",
    f"""WITH {CASES_SQL} SELECT event_id, CASE WHEN value < 20 THEN 'niedrig' WHEN value < 60 THEN 'mittel'
      WHEN value < 90 THEN 'hoch' END AS label FROM cases""",
)
def relevance_label_map(spark, sf_dir):
    v = F.col("value")
    level = F.when(v < 20, "low").when(v < 60, "Medium").when(v < 90, "HIGH").otherwise("other")
    return cases(spark, sf_dir).select("event_id", listing.relevance_label(level).alias("label"))


@query(
    "population_code_map",
    f"""WITH {CASES_SQL} SELECT event_id, CASE population WHEN 'wild birds' THEN 'wild' ELSE population END AS code
    FROM cases""",
)
def population_code_map(spark, sf_dir):
    return cases(spark, sf_dir).select("event_id", listing.population_code(F.initcap("population")).alias("code"))


@query(
    "population_rule",
    f"""WITH {CASES_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'wild' WHEN event_id % 5 = 1 THEN 'captive'
      WHEN event_id % 2 = 0 THEN 'poultry' WHEN event_id % 7 = 0 THEN 'apiary' END AS population FROM cases""",
)
def population_rule(spark, sf_dir):
    i = F.col("event_id")
    wildlife = F.when(i % 5 == 0, " Wild ").when(i % 5 == 1, "Captive wild")
    production = F.when(i % 2 == 0, "Non-poultry birds").otherwise("")
    unit = F.when(i % 7 == 0, "Apiary")
    return cases(spark, sf_dir).select("event_id", listing.population(wildlife, production, unit).alias("population"))


@query(
    "case_view",
    f"""WITH {CASES_SQL} SELECT 'event:' || event_id AS case_id, CASE disease WHEN 'click' THEN 'HPAI' ELSE disease END AS disease,
      CASE population WHEN 'wild birds' THEN 'wild' ELSE population END AS population,
      strftime(reported_at, '%Y-%m-%dT%H:%M') AS reported_at, lat, lon, coalesce(admin2, admin1, country) AS location
    FROM cases""",
)
def case_view(spark, sf_dir):
    return listing.case_view(cases(spark, sf_dir), {"Click": "HPAI"})


@query(
    "month_by_population_stack",
    f"""WITH {CASES_SQL} SELECT strftime(date_trunc('month', reported_at), '%Y-%m-%d') AS month,
      CAST(count(*) FILTER (population = 'poultry') AS BIGINT) AS poultry,
      CAST(count(*) FILTER (population = 'captive') AS BIGINT) AS captive
    FROM cases WHERE reported_at IS NOT NULL GROUP BY 1""",
)
def month_by_population_stack(spark, sf_dir):
    found = stats.monthly_stack(cases(spark, sf_dir), "reported_at", "population", ["poultry", "captive"])
    return found.withColumn("month", F.col("month").cast("string"))


@query(
    "trend_by_day_month",
    """WITH m AS (SELECT date_trunc('month', l_shipdate) AS month, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT strftime(month, '%Y-%m-%d') AS month, l_linestatus, CAST(n AS BIGINT) AS n,
      CAST(n - lag(n) OVER (PARTITION BY l_linestatus ORDER BY month) AS BIGINT) AS change FROM m""",
)
def trend_by_day_month(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = stats.trend(stats.monthly(rows, "l_shipdate", "l_linestatus"), "l_linestatus")
    return found.select(F.col("month").cast("string").alias("month"), "l_linestatus", "n", "change")


@query(
    "m2n_bridge",
    f"""WITH {CASES_SQL} SELECT event_id, doc_id FROM cases JOIN documents ON doc_id IN (event_id % 97, event_id % 89)
    WHERE event_id % 97 <> event_id % 89""",
)
def m2n_bridge(spark, sf_dir):
    events = cases(spark, sf_dir).select("event_id")
    i = F.col("event_id")
    pairs = events.where(i % 97 != i % 89).select(
        "event_id", F.explode(F.array(i % 97, i % 89)).alias("report_id")
    )
    reports = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("report_id"))
    found = joins.bridge(events, pairs, reports)
    return found.select("event_id", F.col("report_id").alias("doc_id"))


@query(
    "values_join",
    f"""WITH {CASES_SQL} SELECT event_id, code FROM cases JOIN (VALUES ('click', 'C'), ('view', 'V'), ('none', 'N')) AS t(disease, code)
    ON cases.disease = t.disease""",
)
def values_join(spark, sf_dir):
    rows = [("click", "C"), ("view", "V"), ("none", "N")]
    return joins.inline(cases(spark, sf_dir), "disease", rows, ["disease", "code"]).select("event_id", "code")


@query(
    "geojson_features",
    f"""WITH {CASES_SQL} SELECT event_id, CAST(lon AS VARCHAR) || '|' || CAST(lat AS VARCHAR) AS coordinates FROM cases
    WHERE lat IS NOT NULL""",
)
def geojson_features(spark, sf_dir):
    features = listing.geojson(cases(spark, sf_dir), ["event_id"])
    schema = "geometry struct<coordinates:array<double>>, properties struct<event_id:bigint>"
    f = features.select(F.from_json("feature", schema).alias("f"))
    return f.select(
        F.col("f.properties.event_id").alias("event_id"),
        F.concat_ws("|", F.col("f.geometry.coordinates").cast("array<string>")).alias("coordinates"),
    )


@query(
    "colour_ramp",
    f"""WITH {CASES_SQL} SELECT event_id, '#' || printf('%02x', CAST(round(255 * v) AS INTEGER)) ||
      printf('%02x', CAST(round(200 - 150 * v) AS INTEGER)) || '40' AS colour
    FROM (SELECT event_id, least(1e0, value / 100) AS v FROM cases)""",
)
def colour_ramp(spark, sf_dir):
    return cases(spark, sf_dir).select(
        "event_id", geo.ramp(F.col("value") / 100, (0, 200, 64), (255, 50, 64)).alias("colour")
    )
