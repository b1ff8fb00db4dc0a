import json

import pytest
from pyspark.sql import functions as F

from tidewarden.plans import config
from tidewarden.sinks import files
from tidewarden.sources import documents, tabular


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def adis_file(tmp_path):
    def write(*changes):
        lines = [";".join(tabular.ADIS_COLUMNS)]
        for c in changes:
            lines.append(";".join(c.get(n, "") for n in tabular.ADIS_COLUMNS))
        path = tmp_path / "adis.csv"
        path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    return write


def test_adis_types(spark, adis_file):
    path = adis_file(
        {"Reference": "DE-1", "Latitude": "47,5", "Cases 1": "3.0", "Dead 1": "-1", "Confirmation date": "2026-05-02", "Suspicion": "true", "Disease type": "NaN"},
        {"Reference": "DE-2", "Latitude": "x", "Confirmation date": "02.05.2026", "Approximate location": "perhaps"},
    )
    raw = tabular.adis(spark, path)
    assert raw.columns[0] == "Reference" and [r.row_number for r in raw.collect()] == [1, 2]
    a, b = tabular.adis_typed(raw).collect()
    assert (a["Latitude"], a["Cases 1"], a["Dead 1"], str(a["Confirmation date"]), a["Suspicion"], a["Disease type"]) == (47.5, 3, None, "2026-05-02", True, None)
    assert (b["Latitude"], b["Confirmation date"], b["Approximate location"]) == (None, None, None)


def test_empres_and_wahis(spark, tmp_path):
    e = tmp_path / "e.csv"
    e.write_text('"Event.ID";"Observation.date..dd.mm.yyyy.";"Human.deaths;"\n"1";"28/03/2026";"0"\n')
    got = tabular.empres(spark, str(e)).first()
    assert got["Human.deaths"] == "0" and str(got["Observation.date..dd.mm.yyyy."]) == "2026-03-28"
    w = tmp_path / "w.csv"
    w.write_text("country;eventId;eventStartDate;submissionDate\nCH;7;01.02.2026;bad\n")
    got = tabular.wahis(spark, str(w)).first()
    assert str(got.eventStartDate) == "2026-02-01" and got.submissionDate is None


def test_report_import_skips_blank_rows(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("id,title\n1, A \n,\n2,\n")
    assert rows(tabular.reports(spark, str(p))) == [("1", "A"), ("2", None)]


def test_first_existing(tmp_path):
    assert tabular.first_existing([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tabular.first_existing([str(tmp_path / "no")])


def test_json_lines(spark, tmp_path):
    assert documents.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "n": {"b": 2}}\n\n[1]\nbroken {\n"x"\n')
    good, bad = documents.tolerant_json_lines(spark, str(p))
    assert {r.line: r.value for r in good.collect()} == {1: {"a": "1", "n": '{"b":2}'}, 3: {"value": "[1]"}, 5: {"value": "x"}}
    assert rows(bad.select("line", "start")) == [(4, "broken {")]
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert documents.flatten(nested).columns == ["a.b", "a.c.d"]


def test_sitemap(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    entry = "<url><loc>{}</loc><lastmod>{}</lastmod></url>"
    p = tmp_path / "s.xml"
    p.write_text(
        f"<urlset {ns}>"
        + entry.format("https://a.org/news/b", "2026-05-01")
        + entry.format("https://a.org/about", "2026-05-01")
        + entry.format("https://a.org/news/a", "2026-04-01T10:00:00Z")
        + entry.format("https://a.org/news/b", "2026-06-01")
        + "</urlset>"
    )
    got = documents.sitemap(spark, str(p), "a.org", "/news/").collect()
    assert [r.source_link for r in got] == ["https://a.org/news/a", "https://a.org/news/b"]
    assert [str(r.last_modified)[:10] for r in got] == ["2026-04-01", "2026-05-01"]


def test_paged_api(spark, tmp_path):
    page = lambda ids, nxt: json.dumps({"count": 3, "next": nxt, "previous": None, "results": [{"id": i, "url": f"u{i}", "title": "t", "published_at": None} for i in ids] + [{"id": None}]})
    (tmp_path / "page1.json").write_text(page([1, 2], "http://x/page2.json"))
    (tmp_path / "page2.json").write_text(page([3], "page1.json"))
    spark.dataSource.register(documents.PagedSource)
    reader = spark.read.format("paged_api").option("pages", str(tmp_path))
    assert sorted(r.id for r in reader.load().collect()) == [1, 2, 3]
    assert reader.option("limit", "2").load().count() == 2
    got = documents.padi_pages(spark, str(tmp_path))
    assert sorted(r.source_link for r in got.collect()) == ["u1", "u2", "u3"]


def test_api_details(spark):
    body = json.dumps(
        {
            "id": 5, "title": " ", "source_title": None, "description": "<p><a href='x'>Named</a></p>", "text": "",
            "sentences": [{"computed_text": "One."}, {"computed_text": "Two."}], "url": None, "external_id": "ext",
            "published_at": "2026-05-02T10:00:00Z", "country": "CH", "lang": "de",
            "machine_classification_labels": [{"name_en": "A"}, {"name": "B"}, {"name_en": "A"}],
        }
    )
    r = documents.padi_articles(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.title, r.source_link, r.fulltext, r.keywords, str(r.publication_date)) == ("Named", "ext", "One.\n\nTwo.", ["A", "B"], "2026-05-02")


def test_articles(spark):
    page = """<html><head><title>Page</title><meta name="description" content="D"><meta name="keywords" content="a, b,">
    <meta property="og:image" content="i.png"><link rel="canonical" href="https://a.org/c"></head><body>
    <section id="detailpage"><div id="main"><h1>Head &amp; line</h1><div class="date">26 Mai 2026</div><div class="category">News</div>
    <div class="text"><p>First <strong>bold</strong> text.</p><h2>Sub</h2><p>Second.</p></div><div class="author">By X</div></div></section></body></html>"""
    df = spark.createDataFrame([("l1", page), ("l2", "<p>no title</p>"), ("l3", None)], "source_link string, html string")
    got = {r.source_link: r for r in documents.articles(df).collect()}
    a = got["l1"]
    assert (a.title, a.description, a.keywords, a.category, a.canonical_url) == ("Head & line", "D", ["a", "b"], "News", "https://a.org/c")
    assert a.fulltext == "# Head & line\n\nFirst **bold** text.\n\n## Sub\n\nSecond." and a.date_text == "26 Mai 2026"
    assert got["l2"].error.startswith("ValueError") and got["l3"].title is None


def test_plain_text(spark):
    df = spark.createDataFrame([("<p>a &amp; b<br>c</p>",), (None,)], "x string")
    assert [r[0] for r in rows(df.select(documents.plain_text(F.col("x"))))] == ["a & b c", None]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True, ["a"])], "b int, a string, c boolean, d array<string>")
    files.json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1,"c":true,"d":["a"]}'
    files.csv(df, str(tmp_path / "c"), ["b", "a", "c", "d", "missing"])
    lines = [r[0] for r in rows(spark.read.text(str(tmp_path / "c")))]
    assert lines[0] == "b,a,c,d,missing" and lines[1].startswith("1,,true,")
    body, page = files.report(spark.range(3).agg(F.count("*").alias("n")), "Title")
    assert json.loads(body) == {"n": 3} and "- n: 3" in page
    files.raw_cache(spark.createDataFrame([("u", b"x")], "url string, body binary"), str(tmp_path / "raw"))
    assert len(spark.read.parquet(str(tmp_path / "raw")).first().content_hash) == 64


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7" + b"x" * 6000)
    (tmp_path / "b.pdf").write_bytes(b"<html>" + b"x" * 6000)
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    assert [r.path[-5:] for r in documents.pdf_files(spark, str(tmp_path)).collect()] == ["a.pdf"]


def test_settings():
    found = config.settings({"workers": 3, "sources": {"news": {"limit": 0}}, "rules": {"radius": 10}})
    assert found.workers == 3 and found.sources["news"].limit == 0 and found.rules.radius == 10
    for bad in ({"workers": 0}, {"sources": {"n": {"limit": -1}}}, {"rules": {"max_snippets": True}}, {"unknown": 1}):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_prompt_schema():
    prompt = "# Task\nx\n# Output schema\n- title (string): t\n- `n` (integer or null): n\n- tags (list of strings): t\n- ok (bool): o\n# End\n- no (int): x\n"
    got = config.prompt_schema(prompt)
    assert [(f.name, f.dataType.simpleString()) for f in got] == [("title", "string"), ("n", "int"), ("tags", "array<string>"), ("ok", "boolean")]
    assert config.prompt_schema("# Output schema\n- a (float): x").names == ["a"]
    with pytest.raises(ValueError):
        config.prompt_schema("nothing")


def test_articles_with_closed_references_only(spark):
    page = "<script>a && b</script><!-- <script> --><h1 class='a&amp;b&ampc'>R&ampD &amp;&lt;&#65;&#66 &nosuch; & &amp</h1><div id='text'><p>x &amp y</p></div>"
    df = spark.createDataFrame([("u", page)], "source_link string, html string")
    r = documents.articles(df, closed_only=True).first()
    assert (r.title, r.fulltext) == ("R&ampD &<A&#66 &nosuch; & &amp", "# R&ampD &<A&#66 &nosuch; & &amp\n\nx &amp y")
    assert documents.articles(df).first().title == "R&D &<AB &nosuch; & &"
