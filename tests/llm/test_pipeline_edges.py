"""Stages of the pipeline on nulls, empty and long texts, repeated rows, empty tables and
clashing names."""

import re

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.conftest import EDGES, documents

GOOD = "a clean document of more than ten plain words that nobody would want to reject or lose"
ROWS = [*EDGES, (20, GOOD, "a"), (21, GOOD, "b"), (20, GOOD, "a"), (22, GOOD + " today", None)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_nothing(spark, nothing, name, stage):
    out = stage(spark, nothing, SMALL)
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == corpus_pipeline.COLUMNS


def test_rules(spark):
    got = corpus_pipeline.keep_by_rules(spark, documents(spark, ROWS), SMALL).collect()
    ids = [r.doc_id for r in got]
    assert {20, 21, 22, 7, 8} <= set(ids) and not {1, 2, 3, 4} & set(ids) and ids.count(20) == 2


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = documents(spark, ROWS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    texts = [r.text for r in got]
    assert texts.count(GOOD) == 1
    assert [r.doc_id for r in got if r.text == EDGES[5][1]] == [6]
    assert sum(not (t or "").strip() for t in texts) == 1  # fingerprint zero is a group, too


def test_decontamination_drops_hits_alone(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = documents(spark, [*ROWS, (50, f"before {item} after", "a")])
    got = corpus_pipeline.decontaminate(spark, docs, SMALL).collect()
    assert len(got) == len(ROWS) and 50 not in {r.doc_id for r in got}


def test_mixing_repeats_whole_documents(spark):
    docs = documents(spark, [r for r in ROWS if r[0] is not None])
    got = corpus_pipeline.mix_sources(spark, docs, SMALL).collect()
    known = {t for _, t, _ in ROWS}
    assert got and all(r.text in known for r in got)
    assert all(re.search(r"[^\x20\x09-\x0D]", r.text) for r in got)  # empty texts are never taken


def test_tokens(spark):
    got = corpus_pipeline.tokens(spark, documents(spark, ROWS), SMALL).collect()
    assert len(got) == len(ROWS) and sorted(r.start for r in got)[0] == 0
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def unlike(n, i=0):
    return " ".join(f"t{i}x{k}" for k in range(n))


def held(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in rows)


def test_rows_that_share_an_id_have_fates_of_their_own(spark):
    clean = [(None, unlike(30, 1), "a"), (None, unlike(30, 2), "a"), (7, unlike(30, 3), "b")]
    want = sorted((i is not None, i or 0, t) for i, t, _ in clean)
    bad = [(None, "x", "a"), (7, "y", "b")]
    docs = documents(spark, [*clean, *bad])
    assert held(corpus_pipeline.keep_by_rules(spark, docs, SMALL).collect()) == want
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = documents(spark, [*clean, *((i, f"before {item} after", s) for i, _, s in bad)])
    assert held(corpus_pipeline.decontaminate(spark, docs, SMALL).collect()) == want
    near = [(3, unlike(30, 9), "a"), (7, unlike(30, 9), "b"), (None, unlike(30, 9), "a"), clean[0]]
    docs = documents(spark, [*clean, *near])
    want = sorted([*want, (True, 3, unlike(30, 9))])
    assert held(corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == want


def test_mixing_takes_rows_that_share_an_id_as_often_as_each_is_due(spark):
    alike = [(5, unlike(40, 0), "a")] * 6
    rows = [*alike, *((None, unlike(40, i), "a") for i in range(1, 7)), *((5, unlike(40, i), "b") for i in range(7, 19))]
    got = corpus_pipeline.mix_sources(spark, documents(spark, rows), SMALL).collect()
    # Sources weigh 3 and 1, share 150 % of all words and stop at twice their size.
    assert sum(r.source == "a" for r in got) == 24 and sum(r.source == "b" for r in got) == 12
    texts = [r.text for r in got]
    assert texts.count(alike[0][1]) == 12 and all(texts.count(t) <= 2 for _, t, _ in rows[6:])
