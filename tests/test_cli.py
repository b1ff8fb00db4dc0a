import pytest
from pyspark.sql import functions as F

from tests.test_streaming import PAGE
from tidewarden.plans import cli
from tidewarden.sources import guards


def test_run_all_redoes_only_what_changed(spark, tmp_path):
    raw, data = str(tmp_path / "raw"), str(tmp_path / "data")
    pages = [(f"https://a.org/n/{i}", PAGE.format(i)) for i in range(4)] + [("https://a.org/n/bad", "<p>x")]
    spark.createDataFrame(pages, "source_link string, html string").write.parquet(raw)
    args = ["run-all", "--raw", raw, "--data-dir", data]
    assert cli.main(args, spark) == 0
    folder = cli.Folder(spark, data)
    first = {r.record_key: r.processed_at for r in folder.read("state").collect()}
    assert len(first) == 5 and folder.read("articles").count() == 4 and folder.read("parse_errors").count() == 1
    changed = [(pages[0][0], PAGE.format("new")), *pages[1:]]
    spark.createDataFrame(changed, "source_link string, html string").write.mode("overwrite").parquet(raw)
    assert cli.main(args, spark) == 0
    second = {r.record_key: r.processed_at for r in folder.read("state").collect()}
    redone = {k for k in first if first[k] != second[k]}
    assert redone == {pages[0][0], "https://a.org/n/bad"}  # a failed record is tried again
    assert folder.read("articles").where(F.contains("fulltext", F.lit("new"))).count() == 1
    assert folder.read("parse_errors").count() == 1
    assert spark.read.option("header", True).csv(f"{data}/export/reports_csv").count() == 4


def test_exit_codes(spark, tmp_path):
    assert cli.main(["parse", "--data-dir", str(tmp_path), "--raw", "none"], spark) == 1
    with pytest.raises(SystemExit):
        cli.arguments(["unknown"])


def test_limit_zero_is_no_limit(spark, tmp_path):
    raw = str(tmp_path / "raw")
    spark.createDataFrame([(f"l{i}", "") for i in range(5)], "source_link string, html string").write.parquet(raw)
    for limit, n in (("2", 2), ("0", 5)):
        data = str(tmp_path / f"d{limit}")
        assert cli.main(["discover", "--raw", raw, "--data-dir", data, "--limit", limit], spark) == 0
        assert cli.Folder(spark, data).read("manifest").count() == n


PROMPT = """Text.

# Output schema

- severity_level (string): how bad
- n_cases (integer): how many

# End
"""


class Model:
    """Answers by title; fails while its flag file is there."""

    def __init__(self, flag):
        self.flag = str(flag)

    def __call__(self, record):
        import os

        if os.path.exists(self.flag) and record["report_id"].endswith("1"):
            raise RuntimeError("no answer")
        return {"severity_level": record["report_id"][-1], "n_cases": 3, "report_id": "ignored"}


def test_sitemap_fetch_and_enrich(spark, tmp_path):
    asked, bodies = tmp_path / "asked", {f"https://a.org/n/{i}": PAGE.format(i) for i in range(3)}

    def opener(url, timeout):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if url.endswith("/2") and not (tmp_path / "up").exists():
            raise OSError("down")
        return 200, bodies[url].encode()

    entries = "".join(f"<url><loc>{u}</loc><lastmod>2026-01-0{i + 1}</lastmod></url>" for i, u in enumerate([*bodies, "https://b.org/n/9"]))
    (tmp_path / "map.xml").write_text(f"<urlset>{entries}</urlset>")
    (tmp_path / "prompt.md").write_text(PROMPT)
    data, flag = str(tmp_path / "data"), tmp_path / "flag"
    flag.write_text("")
    args = ["run-all", "--sitemap", str(tmp_path / "map.xml"), "--host", "a.org", "--path-prefix", "/n/", "--data-dir", data]
    args += ["--prompt", str(tmp_path / "prompt.md"), "--delay-seconds", "0", "--progress-every", "1", "--rdf-output", str(tmp_path / "rdf")]
    model = Model(flag)
    assert cli.main(args, spark, opener, model) == 0
    folder = cli.Folder(spark, data)
    assert folder.read("manifest").count() == 3 and folder.read("raw").count() == 2
    assert [(r.source_link, r.error_type) for r in folder.read("fetch_errors").collect()] == [("https://a.org/n/2", "OSError")]
    got = {r.report_id: (r.severity_level, r.n_cases, r._error) for r in folder.read("enriched").collect()}
    assert got["news:0"] == ("0", 3, None) and got["news:1"][2].startswith("extraction: RuntimeError")
    before = {r.record_key: r.processed_at for r in folder.read("state").where("stage = 'enrich'").collect()}
    flag.unlink()
    (tmp_path / "up").write_text("")
    asked.write_text("")
    assert cli.main(args, spark, opener, model) == 0
    assert asked.read_text().split() == ["https://a.org/n/2"]  # the rest is there
    assert folder.read("raw").count() == 3 and folder.read("fetch_errors").count() == 0
    got = {r.report_id: (r.severity_level, r._error) for r in folder.read("enriched").collect()}
    assert got == {f"news:{i}": (str(i), None) for i in range(3)}
    after = {r.record_key: r.processed_at for r in folder.read("state").where("stage = 'enrich'").collect()}
    assert after["news:0"] == before["news:0"] and after["news:1"] > before["news:1"]
    assert spark.read.text(str(tmp_path / "rdf")).count() > 0
    assert cli.main(["enrich", "--data-dir", data], spark) == 1  # no extractor
    assert cli.main(["discover", "--data-dir", data], spark) == 1  # nothing to read


def test_paths_stay_inside(tmp_path):
    assert guards.inside(str(tmp_path), "a/b").endswith("a/b")
    with pytest.raises(ValueError):
        guards.inside(str(tmp_path), "../x")


def test_fetch_errors_are_rows(spark):
    def opener(url, timeout):
        if "bad" in url:
            raise OSError("no answer")
        return 200, url.encode()

    df = spark.createDataFrame([("a",), ("bad",)], "source_link string")
    got = {r.source_link: r for r in guards.fetch(df, 2, delay=0.0, opener=opener).collect()}
    assert bytes(got["a"].body) == b"a" and got["bad"].error_type == "OSError" and got["bad"].body is None
