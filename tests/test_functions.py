import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import geo, keys, numbers, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_slugs(spark):
    r = one(
        spark,
        a=text.dash_slug(F.lit(" Österreich ")),
        b=text.dash_slug(F.lit("Rumänien")),
        c=text.underscore_slug(F.lit("Österreich – Wien")),
        d=text.underscore_slug(F.lit("HPAI (non-P)")),
        e=text.dash_slug(F.lit(None).cast("string")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("sterreich", "rum-nien", "osterreich_wien", "hpai_non_p", None)


@pytest.mark.parametrize(
    "body, term, acronyms, place",
    [
        ("Die ASP breitet sich aus", "ASP", ("ASP",), (4, 7)),
        ("Aspekte der Lage", "ASP", ("ASP",), None),
        ("äASP", "ASP", ("ASP",), None),
        ("GEFLÜGELPEST im Stall", "Geflügelpest", (), (0, 12)),
        ("😀H5N1", "H5N1", ("H5N1",), (1, 5)),
        ("", "x", (), None),
    ],
)
def test_first_match(spark, body, term, acronyms, place):
    found = one(spark, m=text.first_match(F.lit(body), text.term_pattern(term, acronyms))).m
    assert (tuple(found) if found else None) == place


def test_text_helpers(spark):
    r = one(
        spark,
        subtype=text.subtype(F.lit("wegen h5n1 und H7N9")),
        words=text.word_count(F.lit("  a b c ")),
        none=text.word_count(F.lit("")),
        parts=text.split_list(F.lit("a, ,b,")),
        labels=text.labels_of_terms(F.lit("Export und keulen, KEULUNG"), [("keulen", "K"), ("Keulung", "K"), ("Export", "E")]),
        sentence=text.first_sentence_with(F.lit("Eins. Zwei Export! Drei Export."), ["export"]),
        fenced=text.unfence(F.lit("```json\n{\"a\": 1}\n```")),
        image=text.image_url(F.lit('<p><img alt="" src="/i/a.png"></p>'), "https://x.org/"),
        label=text.strip_label(F.lit("Bild: Foto"), "Bild:", "Quelle:"),
        md=text.markdown([F.lit("# T"), F.lit(" "), F.lit(None).cast("string"), F.lit("x")]),
        pad=text.padded_id("E-", F.lit(7), 4),
        named=text.first_of(F.lit("in Polen und Ungarn"), ["Ungarn", "Polen"]),
    )
    assert r.subtype == "H5N1" and r.words == 3 and r.none == 0
    assert r.parts == ["a", "b"] and r.labels == ["K", "E"]
    assert r.sentence == "Zwei Export!" and r.fenced == '{"a": 1}'
    assert r.image == "https://x.org/i/a.png" and r.label == "Foto"
    assert r.md == "# T\n\nx" and r.pad == "E-0007" and r.named == "Ungarn"


def test_numbers_and_dates(spark):
    r = one(
        spark,
        comma=numbers.decimal(F.lit(" 7,5 ")),
        bad=numbers.decimal(F.lit("x")),
        whole=numbers.unsigned(F.lit("3.9")),
        negative=numbers.unsigned(F.lit("-1")),
        fraction=numbers.unsigned(F.lit("-0.5")),
        yes=numbers.tri_state(F.lit("TRUE")),
        other=numbers.tri_state(F.lit("maybe")),
        swiss=numbers.date_of(F.lit("20.05.2026"), "dd.MM.yyyy"),
        german=numbers.german_date(F.lit("Stand: 26 Mai 2026")),
        unknown=numbers.german_date(F.lit("26 Maj 2026")),
        total=numbers.row_sum([F.lit(None).cast("int"), F.lit(2)]),
        nothing=numbers.row_sum([F.lit(None).cast("int")]),
        half=numbers.half_even(F.lit(0.125), 2),
        first=numbers.first_known(F.lit(" "), F.lit("b")),
    )
    assert (r.comma, r.bad, r.whole, r.negative, r.fraction) == (7.5, None, 3, None, 0)
    assert (r.yes, r.other) == (True, None)
    assert r.swiss == dt.date(2026, 5, 20) and r.german == dt.date(2026, 5, 26) and r.unknown is None
    assert r.total == 2 and r.nothing is None and r.half == 0.12 and r.first == "b"


def test_keys(spark):
    label = F.lit("HPAI(NON-P) in wild birds")
    r = one(
        spark,
        old=keys.situation_key(label, F.lit("Deutschland"), F.lit("2026-05")),
        new=keys.situation_key(F.lit("A.S.F. in wild boar"), F.lit("Deutschland"), F.lit("2026-04"), "0.1.2"),
        missing=keys.situation_key(label, F.lit("Polen"), F.lit(None).cast("string")),
        plain=keys.split_context(F.lit("SGP (Inf. with)"))[1],
        report=keys.report_id(F.lit("news"), F.lit("raw/x.html"), F.lit("https://a.org/b/c-d/")),
        padi=keys.report_id(F.lit("padi_web"), F.lit("raw/77.json"), F.lit("https://a.org/b")),
        file=keys.cache_file_name(F.lit("https://a.org/b")),
        ok=keys.allowed_url(F.lit("https://a.org/news/x"), "a.org", "/news/"),
        bad=keys.allowed_url(F.lit("not a url"), "a.org", "/"),
        snippet=keys.snippet_id(F.lit("l"), F.lit("t"), F.lit(3)),
        month=keys.month_of_text(F.lit("2026-05-01")),
    )
    assert r.old == "hpai-non-p-in-wild-birds|deutschland|2026-05"
    assert r.new == "a-s-f|deutschland|2026-04"
    assert r.missing.endswith("|polen|unknown") and r.plain is None
    assert r.report == "news:c-d" and r.padi == "padi_web:77"
    digest = hashlib.sha256(b"https://a.org/b").hexdigest()[:12]
    assert r.file == f"b-{digest}.html"
    assert r.ok and not r.bad and r.month == "2026-05"
    assert r.snippet == "snippet:" + hashlib.sha1(b"l|t|3").hexdigest()[:12]


def test_fingerprint_ignores_order(spark):
    r = one(
        spark,
        a=keys.fingerprint(x=F.lit(1), y=F.lit(None).cast("string")),
        b=keys.fingerprint(y=F.lit(None).cast("string"), x=F.lit(1)),
        c=keys.fingerprint(x=F.lit(1), y=F.lit("")),
    )
    assert r.a == r.b != r.c


def test_geo(spark):
    here, nowhere = F.lit(47.3769), F.lit(None).cast("double")
    r = one(
        spark,
        zurich=geo.haversine_km(here, F.lit(8.5417), geo.BERN_EXPORT),
        none=geo.haversine_km(nowhere, F.lit(8.0), geo.BERN_EXPORT),
        at_once=geo.proximity(nowhere, 10.0),
        no_radius=geo.decay(F.lit(5.0), 0.0),
        stored=geo.relevance(F.lit(0.3), F.lit(True), F.lit(0.0), 10.0),
        level=geo.priority(F.lit(0.5)),
        capped=geo.score(F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        cell=geo.grid_cell(F.lit(46.95)),
        colour=geo.ramp(F.lit(2.0), (0, 0, 0), (255, 128, 0)),
        cos=geo.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))),
        zero=geo.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
    )
    assert r.zurich == pytest.approx(95.5, abs=1) and r.none is None
    assert (r.at_once, r.no_radius, r.stored, r.level, r.capped) == (1.0, 0.0, 0.3, 2, 1.0)
    assert r.cell == 470 and r.colour == "#ff8000"
    assert r.cos == pytest.approx(0.7071, abs=1e-3) and r.zero is None
