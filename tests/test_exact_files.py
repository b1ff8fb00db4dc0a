import csv
import datetime as dt
import json

import pytest

from tidewarden.sinks import exact

ROWS = [
    (1, None, True, ["b", "ä"], dt.date(2026, 5, 1), dt.datetime(2026, 5, 1, 2, 3, 4), {"z": 1, "a": 2}),
    (2, 'say "hi",\nthere', False, [], None, None, {}),
    (3, "", None, None, dt.date(1999, 1, 1), dt.datetime(1999, 1, 1), None),
]
SCHEMA = "id int, t string, flag boolean, tags array<string>, d date, at timestamp, m map<string,int>"


@pytest.fixture()
def df(spark):
    exact.register(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "id")


def save(df, path, mode="overwrite", **options):
    df.write.format("exact_files").mode(mode).options(path=str(path), **options).save()
    return exact.summary(str(path))


def whole(path, names):
    return "".join((path / n).read_text(newline="") for n in names)


def expected():
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    shown = lambda v: v.replace(tzinfo=dt.UTC) if isinstance(v, dt.datetime) else v
    return [{n: (shown(v).isoformat() if hasattr(v, "isoformat") else v) for n, v in zip(names, r, strict=True)} for r in ROWS]


def test_json_lines(df, tmp_path):
    found = save(df, tmp_path / "out", form="jsonl")
    lines = whole(tmp_path / "out", found["files"]).splitlines()
    want = [json.dumps(r, ensure_ascii=False, sort_keys=True) for r in expected()]
    assert sorted(lines) == sorted(want)
    assert found["rows"] == 3 and not list((tmp_path / "out").glob("_staging*"))


def test_csv_as_the_csv_module_writes_it(df, tmp_path):
    columns = ["id", "t", "flag", "tags", "missing"]
    found = save(df.coalesce(1).sortWithinPartitions("id"), tmp_path / "out", form="csv", columns=json.dumps(columns))
    import io

    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns)
    for r in ROWS:
        tags = "" if r[3] is None else json.dumps(r[3], ensure_ascii=False)
        writer.writerow([r[0], r[1] or "", "" if r[2] is None else str(r[2]).lower(), tags, ""])
    assert whole(tmp_path / "out", found["files"]) == out.getvalue()


def test_one_file_appended_to(df, tmp_path, monkeypatch):
    out = tmp_path / "out"
    save(df.where("id < 3").orderBy("id"), out, form="csv", single="true", columns='["id"]')
    found = save(df.where("id = 3"), out, mode="append", form="csv", single="true", columns='["id"]')
    assert len(found["files"]) == 1 and whole(out, found["files"]).split() == ["id", "1", "2", "3"]
    assert found["rows"] == 3 and found["rows_of_job"] == 1
    assert len(list(out.glob("all-*"))) == 1
    found = save(df.where("id = 3"), out, form="csv", columns='["id"]')
    assert found["rows"] == 1 and len(list(out.glob("*.csv"))) == 1


def test_lines_have_their_head_in_each_file(spark, tmp_path):
    exact.register(spark)
    found = save(spark.range(9).selectExpr("cast(id as string) as v").repartition(3), tmp_path / "o", form="lines", head="# head")
    assert len(found["files"]) == 3
    assert all((tmp_path / "o" / n).read_text().startswith("# head\n") for n in found["files"])


def test_a_failed_job_leaves_what_was_there(spark, df, tmp_path):
    out = tmp_path / "out"
    first = save(df, out, form="jsonl")
    bad = spark.range(4).selectExpr("if(id = 3, raise_error('no'), id) as id").repartition(2)
    with pytest.raises(Exception):
        save(bad, out, form="jsonl")
    assert exact.summary(str(out)) == first and not list(out.glob("_staging*"))
    with pytest.raises(Exception):
        save(df, out, form="xml")


def test_empty_table_has_a_header(df, tmp_path):
    found = save(df.limit(0), tmp_path / "o", form="csv", columns='["id"]')
    assert found["rows"] == 0 and whole(tmp_path / "o", found["files"]) in ("id\r\n", "")
