"""Registered queries against SQL, or against brute force on the smallest tables."""

import hashlib
import re

import pytest

from tests.conftest import SMALL, canon
from tests.llm import brute
from tidewarden.llm import decontamination, registry, simhash, token_output


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SMALL)
    found = oracle.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), found.columns)


def test_each_operator_has_a_query():
    names = registry.queries()
    assert {re.match(r"op\d+_|pipeline", n)[0] for n in names} == {*(f"op{i}_" for i in range(1, 14)), "pipeline"}


def test_op2(spark, oracle):
    rows = registry.queries()["op2_quality_classifier"](spark, SMALL).collect()
    labels = dict(oracle.sql("SELECT doc_id, quality FROM labels").fetchall())
    hits = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(k == bool(q) for k, q in hits) / len(hits) > 0.95
    assert len(rows) == oracle.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(0 <= r.score <= 1 for r in rows)


def test_op3(spark, small_docs):
    import public_tokenizers

    rows = [tuple(r) for r in registry.queries()["op3_token_output"](spark, SMALL).collect()]
    assert sorted(rows) == token_output.brute_force(small_docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_op4(spark, small_docs):
    rows = registry.queries()["op4_secret_scan"](spark, SMALL).collect()
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows}
    assert got == {i: brute.secrets(t) for i, t in small_docs}


def test_op5(spark, oracle):
    rows = registry.queries()["op5_html_extraction"](spark, SMALL).collect()
    got = {r.page_id: r.text for r in rows}
    want = {i: brute.article(h) for i, h in oracle.sql("SELECT page_id, html FROM pages").fetchall()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.99 * len(want)
    assert all(r.n_chars == len(r.text) for r in rows) and len(got) == len(want)


def test_op6(spark, small_docs):
    rows = registry.queries()["op6_pii"](spark, SMALL).collect()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows}
    assert got == {i: brute.personal(t) for i, t in small_docs}
    for r in rows:  # all spans hold the base ones
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_op7(spark, oracle):
    first = registry.queries()["op7_mixing"](spark, SMALL).collect()
    again = registry.queries()["op7_mixing"](spark, SMALL).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    sources = dict(oracle.sql("SELECT doc_id, source FROM documents").fetchall())
    texts = dict(oracle.sql("SELECT doc_id, text FROM documents").fetchall())
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    targets = brute.targets(sizes, sources)
    taken = {}
    for r in first:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(targets[sources[r.doc_id]])
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.taken
    for source, words in taken.items():
        assert words == round(targets[source])


def test_op10(spark, small_docs):
    rows = registry.queries()["op10_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == simhash.brute_force(small_docs)


def test_pipeline_against_brute_force(spark, oracle, small_docs):
    import public_tokenizers

    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["quality rules"](spark, docs, SMALL).cache()
    kept = {r[0] for r in oracle.sql(f"SELECT doc_id FROM ({registry.oracle_sql()['op9_quality_rules']}) WHERE kept").fetchall()}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept
    texts = dict(small_docs)
    docs = stage["near duplicates"](spark, docs, SMALL).cache()
    groups = simhash.brute_force([(i, texts[i]) for i in kept])
    kept = {i for i, (_, c) in groups.items() if c == i}
    assert {r.doc_id for r in docs.collect()} == kept
    docs = stage["decontamination"](spark, docs, SMALL).cache()
    items = {str(i): t for i, t in oracle.sql("SELECT item_id, text FROM benchmark").fetchall()}
    kept = {i for i in kept if not decontamination.brute_force(texts[i], items)[1]}
    assert {r.doc_id for r in docs.collect()} == kept
    sources = dict(oracle.sql("SELECT doc_id, source FROM documents").fetchall())
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")) for i in kept}
    targets = brute.targets(sizes, sources)
    mixed = stage["mixing"](spark, docs, SMALL).cache()
    got = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == columns and set(got) <= kept and max(map(got.count, set(got))) <= 2
    for source, target in targets.items():
        own = [sizes[i] for i in kept if sources[i] == source]
        assert abs(sum(sizes[i] for i in got if sources[i] == source) - target) <= max(own) / 2 + 1
    rows = [tuple(r) for r in stage["token output"](spark, mixed, SMALL).collect()]
    order = [(i, texts[i]) for i in got]
    want = token_output.brute_force(order, public_tokenizers.path("byte_bpe_50k.json"), keep_order=True)
    assert sorted(rows, key=lambda r: r[1]) == want
    ran = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(ran, key=lambda r: r[1]) == want
