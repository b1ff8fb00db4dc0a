import datetime as dt

from pyspark.sql import functions as F

from tidewarden.plans import pipeline
from tidewarden.operators import relevance
from tidewarden.streaming import events as streams
from tidewarden.streaming.keyed_state import KeyedState

STATE = "source string, stage string, record_key string, fingerprint string, processed_at bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(spark, folder, *batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
        del i
    return spark.read.parquet(folder).schema


def test_state_goes_on_over_runs(spark, tmp_path):
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = files(spark, src, [("n", "p", "a", "1", 1), ("n", "p", "b", "1", 1)], schema=STATE)
    held = KeyedState(spark, str(tmp_path / "state"), STATE)
    streams.run_available(streams.stream(spark, src, schema), held.upsert, check)
    assert rows(held.read()) == [("n", "p", "a", "1", 1), ("n", "p", "b", "1", 1)]
    files(spark, src, [("n", "p", "a", "2", 5)], [("n", "p", "a", "old", 0)], schema=STATE)
    held = KeyedState(spark, str(tmp_path / "state"), STATE)  # as after a restart
    streams.run_available(streams.stream(spark, src, schema), held.upsert, check)
    assert rows(held.read()) == [("n", "p", "a", "2", 5), ("n", "p", "b", "1", 1)]


def test_dead_letters(spark):
    got = {}
    df = spark.createDataFrame([(1, "x"), (None, "y")], "id int, v string")
    streams.with_dead_letters(df, "id > 0", lambda d: got.update(good=d.count()), lambda d: got.update(bad=d.count()))
    assert got == {"good": 1, "bad": 1}


def memory(spark, df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_windows_sessions_and_alarms(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, user string, value double"
    made = [(at(1), "a", 1.0), (at(1, 20), "a", 2.0), (at(3), "a", 4.0), (at(1, 5), "b", 8.0)]
    src = str(tmp_path / "ev")
    kind = files(spark, src, made, schema=schema)
    df = streams.stream(spark, src, kind)
    got = memory(spark, streams.tumbling(df, "ts", "user"), "tumbling", "complete", tmp_path)
    assert rows(got.select("user", "n", "total")) == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 8.0)]
    got = memory(spark, streams.sessions(df, "ts", "user"), "sessions", "complete", tmp_path)
    assert rows(got.select("user", "n")) == [("a", 1), ("a", 2), ("b", 1)]
    got = memory(spark, streams.sliding(df, "ts", "user", "2 hours", "1 hour"), "sliding", "complete", tmp_path)
    assert got.where("user = 'b'").count() == 2
    got = memory(spark, streams.rising(df, "user", 3), "rising", "append", tmp_path)
    assert rows(got) == [("a", 3)]
    got = memory(spark, streams.distinct_within(df, "ts", ["user"]), "distinct_within", "append", tmp_path)
    assert got.count() == 2
    now = dt.datetime(2024, 1, 8, 2)
    assert streams.look_back(spark.read.parquet(src), "ts", 7, now).count() == 1


PAGE = """<title>x</title><h1>Ausbruch der Geflügelpest</h1><div class="date">3 Mai 2026</div><div class="text"><p>HPAI H5N1 und Keulung. {}</p></div>"""


def test_staged_pipeline(spark, tmp_path):
    raw = spark.createDataFrame(
        [("https://a.org/n/one", PAGE.format("")), ("https://a.org/n/two", PAGE.replace("Ausbruch", "Lage").replace("Geflügelpest", "Dinge").replace("HPAI H5N1 und Keulung", "Nichts")), ("https://a.org/n/bad", "<p>x")],
        "source_link string, html string",
    )
    found = raw.select("source_link", F.lit(None).cast("timestamp").alias("last_modified"))
    stages = pipeline.run(found, raw, "news")
    assert stages.articles.count() == 2 and stages.parse_errors.count() == 1
    r = stages.reports.first()
    assert r.report_id == "news:one" and r.rule_disease_type == "H5N1" and r.situation_month == "2026-05"
    assert r.rule_matched_terms == ["HPAI", "H5N1", "Geflügelpest", "Ausbruch", "Keulung"] and r.extraction_confidence == "high"
    assert pipeline.run_all(spark, stages, str(tmp_path / "out")) == 0
    lines = [x[0] for x in spark.read.text(str(tmp_path / "out/triples")).collect()]
    assert any(x.startswith("tsd:candidate_news_one rdf:type ts:ExtractionCandidate") for x in lines)
    front = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "out/reports_csv_mock_data_")).first()
    assert front.id == "1" and front.url == "https://a.org/n/one" and front.relevance_score == "5"
    assert front.report_date == "2026-05-03" and front.body and front.source == "news"
    none = pipeline.run(found, raw.where("source_link like '%two'"), "news", rules=relevance.Rules())
    assert pipeline.run_all(spark, none, str(tmp_path / "none")) == 1
