import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators import enrichment, filters, incremental, joins, listing, profiling, relevance, scoring, stats, synthetic


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_passes_dates_but_not_choices(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", "2024-01-05"), (3, "b", "2024-02-01")], "i int, k string, d string")
    assert [r[0] for r in rows(filters.date_range(df, "d", "2024-01-01", "2024-01-31"))] == [1, 2]
    assert [r[0] for r in rows(filters.multi_select(df, {"k": ["a"], "d": []}))] == [2]
    assert df.count() == filters.multi_select(df, {}).count() == filters.search(df, ["k"], " ").count()
    good, bad = filters.malformed(df, ["k", "d"])
    assert (good.count(), bad.count()) == (2, 1)


def test_quantile_trim_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert filters.quantile_trim(df, "v").count() == 0


def test_document_links(spark):
    df = spark.createDataFrame(
        [("a.pdf", "HPAI map"), ("/document/download?x", None), ("hpai.html", "HPAI"), (None, None)], "href string, text string"
    )
    assert [r[0] for r in rows(filters.document_links(df))] == ["a.pdf"]


def test_snippets_drop_equal_texts_and_cap(spark):
    body = "HPAI und Vogelgrippe. " + "x" * 300 + " Ausbruch"
    df = spark.createDataFrame([("l", body), ("m", "Aspekte"), ("n", "")], "source_link string, body string")
    found = {r.source_link: r for r in relevance.assess(df, F.col("body")).collect()}
    assert found["l"].matched_terms == ["HPAI", "Vogelgrippe", "Ausbruch"]
    assert found["l"].relevance_score == 3
    assert found["m"].relevance_score == 0 and not found["n"].is_relevant
    same = relevance.Rules(terms=("ab", "cd"), acronyms=(), radius=90)
    one = relevance.assess(spark.createDataFrame([("l", "ab cd")], "source_link string, body string"), F.col("body"), rules=same).first()
    assert one.relevance_score == 2 and [s.text for s in one.evidence_snippets] == ["ab cd"]
    capped = relevance.Rules(terms=tuple("abcdefg"), acronyms=(), radius=0, max_snippets=5)
    one = relevance.assess(spark.createDataFrame([("l", "a b c d e f g")], "source_link string, body string"), F.col("body"), rules=capped).first()
    assert one.relevance_score == 7 and len(one.evidence_snippets) == 5


def test_neighbours_sum_nine_cells(spark):
    df = spark.createDataFrame([(0, 0, 2), (1, 1, 3), (2, 0, 5)], "cell_lat int, cell_lon int, n bigint")
    found = {(a, b): n for a, b, n in rows(scoring.neighbour_counts(df))}
    assert found[0, 0] == 5 and found[1, 1] == 10 and found[2, 0] == 8


def test_daily_fills_gaps_and_nothing(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-04", 2.0), (None, 9.0)], "d string, v double")
    got = [(str(a), b) for a, b in rows(stats.daily(df, "d", "v").orderBy("day"))]
    assert got == [("2024-01-01", 1.0), ("2024-01-02", 0.0), ("2024-01-03", 0.0), ("2024-01-04", 2.0)]
    assert stats.daily(df.where("v > 99"), "d", "v").count() == 0


def test_reach(spark):
    df = spark.createDataFrame(
        [("a", "1", "x"), ("a", "1", "x"), ("b", "1", "x"), ("b", "1", "y"), ("c", "1", "x"), ("c", "2", "x"), ("d", None, None)],
        "k string, two string, three string",
    )
    assert dict(rows(stats.reach(df, "k", ("one", "two", "three")))) == {"a": "local", "b": "regional", "c": "national", "d": "unknown"}


def test_manifest_keeps_metadata_of_unchanged_rows(spark):
    found = spark.createDataFrame([("a", 1), ("b", 2), ("n", None)], "source_link string, last_modified int")
    old = spark.createDataFrame(
        [("a", 1, "ra"), ("b", 1, "rb"), ("n", None, "rn"), ("z", 1, "rz")], "source_link string, last_modified int, raw_html_path string"
    )
    got = {r.source_link: r.raw_html_path for r in incremental.merge_manifest(found, old, ["raw_html_path"]).collect()}
    assert got == {"a": "ra", "b": None, "n": "rn", "z": "rz"}


def test_overlay_overwrites_only_given_keys(spark):
    df = spark.createDataFrame([(1, "x", "y", '{"a": null, "z": 5}'), (2, "x", "y", '{"b": "B"}'), (3, "x", "y", "bad")], "i int, a string, b string, j string")
    got = rows(incremental.overlay(df, "j", [T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]).orderBy("i"))
    assert got == [(1, None, "y"), (2, "x", "B"), (3, "x", "y")]


def test_head_split(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "pos int")
    head, rest = incremental.head_split(df, 2)
    assert sorted(rows(head)) == [(0,), (1,)] and rest.count() == 3
    head, rest = incremental.head_split(df, 0)
    assert head.count() == 5 and rest.count() == 0


def test_enrichment_keeps_errors_as_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", None)], "report_id string, level string")

    def extract(record):
        if record["report_id"] == "b":
            raise ValueError("no answer")
        return {"level": "high", "report_id": "other"}

    got = {r.report_id: r for r in enrichment.enrich(df, extract, [T.StructField("level", T.StringType())], 2).collect()}
    assert got["a"].level == "high" and got["a"]._error is None
    assert got["b"].level is None and got["b"]._error == "extraction: ValueError: no answer"
    assert tuple(enrichment.error_count(spark.createDataFrame(list(got.values()))).first()) == (1, 2)


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"a":1}\n```',), ("[1]",), ("nonsense",)], "x string")
    assert [r[0] for r in rows(df.select(enrichment.parse_answer(F.col("x"))))] == ['{"a":1}', None, None]


def test_nearest_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(0.5,), (0.0,)], "t double")
    got = rows(joins.nearest(df, [(0.0, 1.0), (1.0, 2.0)]))
    assert got == [(0.5, 0, 1.0), (0.0, 0, 1.0)]


def test_numbering_and_pages(spark):
    df = spark.createDataFrame([(i,) for i in range(250)], "k int")
    got = rows(listing.numbered(df, ["k"]))
    assert sorted(got) == [(i, i + 1) for i in range(250)]
    assert rows(listing.page(listing.sort(df, [("k", True)], "k"), 9, 100, 250))[0] == (49,)


def test_profile_tells_nested_values_apart(spark):
    df = spark.createDataFrame([(["a"],), (["a"],), (["b"],), (None,)], "x array<string>")
    r = profiling.schema_profile(df).first()
    assert (r.missing, r.missing_percent, r.n_unique) == (1, 25.0, 2)
    assert profiling.schema_profile(df.where("false")).first().missing == 0


def test_top_counts_label_missing(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), (None,)], "x string")
    assert rows(stats.top_counts(df, "x", 2)) == [("Missing", 2), ("a", 1)]


def test_synthetic_counts_hold(spark):
    df = synthetic.flyway_events(spark.range(2000).withColumnRenamed("id", "event_id"))
    assert df.where("dead > cases or cases > susceptible or t < 0 or t > 1").count() == 0
    assert rows(df.orderBy("event_id")) == rows(synthetic.flyway_events(spark.range(2000).withColumnRenamed("id", "event_id")).orderBy("event_id"))
    got = synthetic.nullable(df, "event_id", lat=10)
    assert got.where("lat is null").count() == 200


def test_case_view_and_geojson(spark):
    df = spark.createDataFrame(
        [(1, "HPAI", "Wild birds", "2024-01-02 03:04:05", 47.0, 8.0, None, "Z", "CH"), (2, None, None, None, None, None, None, None, "CH")],
        "event_id int, disease string, population string, reported_at string, lat double, lon double, admin2 string, admin1 string, country string",
    ).withColumn("reported_at", F.col("reported_at").cast("timestamp"))
    view = listing.case_view(df, {"hpai": "H"})
    first = view.orderBy("case_id").first()
    assert (first.case_id, first.disease, first.population, first.reported_at, first.location) == ("event:1", "H", "wild", "2024-01-02T03:04", "Z")
    features = [json.loads(r[0]) for r in rows(listing.geojson(df, ["event_id"]))]
    assert features[0]["geometry"]["coordinates"] == [8.0, 47.0] and len(features) == 1


@pytest.mark.parametrize("label, want", [("LOW", "niedrig"), ("high", "hoch"), ("other", None), (None, None)])
def test_relevance_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "x string")
    assert df.select(listing.relevance_label(F.col("x"))).first()[0] == want
