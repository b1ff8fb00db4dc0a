import pytest
from pyspark.sql import functions as F

from tidewarden.sources import tabular
from tidewarden.triples import emit, match, model, quality


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def notification(**changes):
    base = {"Reference": "DE-1", "Country/Territory": "Deutschland", "Disease name": "A.S.F. in wild boar", "Confirmation date": "2026-05-02"}
    base |= changes
    return tuple(base.get(c) for c in tabular.ADIS_COLUMNS)


@pytest.fixture()
def notifications(spark):
    made = [
        notification(**{"Latitude": "47,5", "Longitude": "8", "Location": "Ort", "Measuring unit 1": "Tiere", "Cases 1": "3.0", "Dead 1": "N/A"}),
        notification(**{"Reference": "DE-2", "Confirmation date": "NaN", "Suspicion/Start date": "2026-04-30", "Location": "Ort", "Cases 1": "9"}),
        notification(**{"Reference": "DE-3", "Confirmation date": None, "Disease name": None}),
        notification(**{"Reference": " "}),
    ]
    schema = tabular.strings(tabular.ADIS_COLUMNS)
    return spark.createDataFrame(made, schema).withColumn("row_number", F.monotonically_increasing_id() + 1)


def test_notifications_become_events_and_situations(notifications):
    t = model.as_set(emit.adis_triples(notifications)).cache()
    keys = {r.o for r in t.where("p = 'ts:hasSituationKey'").collect()}
    assert keys == {"a-s-f-in-wild-boar|deutschland|2026-05", "a-s-f-in-wild-boar|deutschland|2026-04", "unknown|deutschland|unknown"}
    assert {r["class"]: r.n for r in match.count_by_class(t).collect()}["ts:OutbreakEvent"] == 3
    assert rows(t.where("p = 'ts:casesCount'").select("s", "o")) == [("tsd:meas_de-1", "3")]
    assert t.where("p = 'ts:latitude'").count() == 1 and t.where("p = 'ts:deadCount'").count() == 0
    month = t.where("p = 'ts:situationMonth' and o = 'unknown'").first()
    assert month.datatype is None
    assert quality.shape_violations(t).where("class = 'ts:OutbreakEvent'").count() == 0
    report = quality.report(t).first()
    assert (report.n_events, report.n_situations, report.n_source_rows, report.n_linked) == (3, 3, 3, 3)


def test_second_version_drops_contexts(notifications):
    t = model.as_set(emit.adis_triples(notifications, "0.1.2"))
    keys = {r.o for r in t.where("p = 'ts:hasSituationKey'").collect()}
    assert "a-s-f|deutschland|2026-05" in keys
    labels = {r.o for r in t.where("p = 'skos:prefLabel'").collect()}
    assert "A.S.F." in labels and "A.S.F. in wild boar" not in labels


def test_reports(spark):
    schema = (
        "report_id string, source_link string, relevance_level string, severity_rationale string, consequences string,"
        " situation_key string, situation_month string, disease_concept_id string, country_concept_id string,"
        " evidence_snippets array<struct<snippet_id:string,text:string,locator:string,matched_terms:array<string>>>,"
        " prevention_measures array<struct<text:string>>, research_references array<struct<title:string,url:string>>"
    )
    full = ("news:a-b", "https://x/a-b", "High", "", "none sold", "hpai|ch|2026-05", "2026-05", "hpai", "country-ch",
            [("snippet:0a1b", "t", "char[0:1]", ["HPAI", "ASP"]), (None, "u", None, [])], [("wash",)], [("T", "https://t")])
    bare = ("news:c", None, None, None, None, "k", None, None, None, None, None, None)
    t = model.as_set(emit.report_triples(spark.createDataFrame([full, bare], schema))).cache()
    got = {(r.s, r.p): r.o for r in t.collect()}
    assert got["tsd:candidate_news_a_b", "ts:extractedFromSource"] == "tsd:news_news_a_b"
    assert got["tsd:relevance_news_a_b", "ts:hasRelevanceLevel"] == "tss:relevance-high"
    assert ("tsd:severity_news_a_b", "rdf:type") not in got  # blank inputs make no node
    assert got["tsd:consequence_news_a_b_1", "ts:consequenceText"] == "none sold"
    assert got["tsd:prevention_news_a_b_1", "ts:preventionMeasureText"] == "wash"
    assert got["tsd:research_news_a_b_1", "ts:researchURL"] == "https://t"
    assert got["tsd:candidate_news_a_b", "ts:candidateDescribesSituation"] == "tsd:situation_hpai_ch_2026_05"
    assert t.where("s = 'tsd:snippet_0a1b' and p = 'ts:rawMatchedTerm'").count() == 2
    assert got["tsd:snippet_2", "ts:snippetText"] == "u"
    assert t.where("s = 'tsd:candidate_news_c'").count() == 3 and t.where("o is null or o = ''").count() == 0


@pytest.fixture()
def graph(spark):
    made = [("e1", "rdf:type", "E"), ("e2", "rdf:type", "E"), ("e1", "in", "s1"), ("e2", "in", "s1"), ("s1", "month", "5"),
            ("r1", "about", "s1"), ("r1", "title", "T"), ("e1", "same", "e1"), ("r2", "url", "U"), ("e1", "in", "s1")]
    return model.as_set(spark.createDataFrame([(*m, "iri", None, "g") for m in made], "s string, p string, o string, kind string, datatype string, graph string"))


def test_patterns(graph):
    assert rows(match.solve(graph, [("?e", "rdf:type", "E"), ("?e", "in", "?s"), ("?s", "month", "?m")])) == [("s1", "e1", "5"), ("s1", "e2", "5")]
    assert rows(match.solve(graph, [("?e", "same", "?e")])) == [("e1",)]
    found = match.optional(match.solve(graph, [("?e", "rdf:type", "E")]), graph, [("?e", "same", "?x")])
    assert {r.e: r.x for r in found.collect()} == {"e1": "e1", "e2": None}
    assert rows(match.path(graph, "e", ["in", "^about", "title"], "t")) == [("e1", "T"), ("e2", "T")]
    with pytest.raises(ValueError):
        match.solve(graph, [("?a", "in", "?b"), ("?c", "title", "?d")])


def test_one_variable_from_two_optional_parts(graph):
    found = match.solve(graph, [("?r", "about", "?s")]).select("r").unionByName(match.solve(graph, [("?r", "url", "?u")]).select("r"))
    assert rows(match.optional_into(found, graph, "r", ["title", "url"], "research")) == [("r1", "T"), ("r2", "U")]
    assert rows(match.distinct_values(graph, "in")) == [("s1",)]
    assert model.union(graph, graph).count() == graph.count()


def test_checks(spark):
    df = spark.createDataFrame([(47.0, 8.0, "a"), (None, 8.0, "b"), (91.0, 8.0, "a|b|2026-05")], "lat double, lon double, situation_key string")
    assert tuple(quality.coordinate_buckets(df).first()) == (1, 1, 1)
    assert quality.malformed_keys(df).count() == 2
