"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import EDGES, documents
from tidewarden.llm import (
    decontamination,
    html_extraction,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    token_output,
    url_filters,
)
from tidewarden.llm.shared import scratch_path


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


ITEMS = [(1, "same text here for all of them to share in full"), (2, None), (3, ""), (4, "One!"), (5, "ONE?")]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination_edges(spark, edges):
    got = decontamination.hits(edges, benchmark(spark, ITEMS)).collect()
    want = sorted(str(decontamination.brute_force(t, {str(i): x for i, x in ITEMS})) for _, t, _ in EDGES)
    assert sorted(str((r.n_words, r.n_hit, sorted(r.item_ids))) for r in got) == want


def test_decontamination_offsets_and_many_automata(spark, monkeypatch):
    text = "Ünder -- the QUICK, brown fox? é"
    docs = documents(spark, [(1, text, "a"), (2, "nothing", "a")])
    items = [(i, f"word{i} other{i}") for i in range(40)] + [(99, "quick brown")]
    one = {r.doc_id: r for r in decontamination.hits(docs, benchmark(spark, items), 2).collect()}
    assert [text[s.start : s.end] for s in one[1].spans] == ["QUICK, brown"]
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 50)
    assert len(list(decontamination.matchers(benchmark(spark, items), 2))) > 5
    many = {r.doc_id: r for r in decontamination.hits(docs, benchmark(spark, items), 2).collect()}
    assert one == many


def test_items_without_an_id_hit_and_count_as_one(spark):
    items = [(None, "one two three"), (None, "five six"), (3, "five six")]
    docs = documents(spark, [(1, "zero one two three four", "a"), (2, "five six", "a"), (3, "none", "a")])
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.hits(docs, benchmark(spark, items)).collect()}
    assert got == {1: (3, [None]), 2: (2, ["3", None]), 3: (0, [])}


def test_decontamination_random(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 7)))) for i in range(12)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40))), "a") for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontamination.hits(documents(spark, docs), benchmark(spark, items), 4).collect()}
    assert got == {i: decontamination.brute_force(t, {str(k): x for k, x in items}, 4) for i, t, _ in docs}


def test_decontamination_by_many_automata(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("abcde")
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(rng.randint(0, 7))) for i in range(12)] + [(50, sentence(90)), (None, "a b c d e"), (51, None)]
    docs = [(i, sentence(rng.randint(0, 40)).replace(" ", " -- "), "a") for i in range(60)]
    docs += [(80, "a b c d e", "a"), (80, "a b c d e", "a"), (None, "a b c d e", "a"), (70, None, None), (71, "none of it", "a")]
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", 40)
    monkeypatch.setattr(decontamination, "PIECE_WINDOWS", 8)
    made = list(decontamination.matchers(benchmark(spark, items), 5))
    assert len(made) > 5 and all(len(m.patterns) < 50 for m in made)
    got = decontamination.hits(documents(spark, docs), benchmark(spark, items), 5).collect()
    want = [(i, *decontamination.brute_force(t, {None if k is None else str(k): x for k, x in items}, 5)) for i, t, _ in docs]
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got) == sorted(map(str, want))
    texts = {i: t for i, t, _ in docs}
    for r in got:
        words = decontamination.normal_words(texts[r.doc_id])
        assert [decontamination.normal_words(texts[r.doc_id][s.start : s.end]) for s in r.spans] == [words[w.first : w.last + 1] for w in r.words]
    none = decontamination.hits(documents(spark, []).limit(0), benchmark(spark, items), 5)
    assert none.collect() == []


def test_decontamination_of_nothing(spark, nothing, edges):
    assert rows(decontamination.hits(nothing, benchmark(spark, ITEMS))) == []
    empty = decontamination.hits(edges, benchmark(spark, []).limit(0))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(EDGES)


# 2


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    got = quality_classifier.scores(edges, labels).collect()
    assert len(got) == len(EDGES) and all(r.kept == (r.score >= 0.5) for r in got)
    assert rows(quality_classifier.scores(nothing, labels)) == []
    none = quality_classifier.scores(edges, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and all(r.kept for r in none)


def test_classifier_held_out(spark):
    rng = random.Random(1)
    made, truth = [], {}
    for i in range(400):
        truth[i] = int(i % 3 > 0)
        words = [rng.choice(["the", "river", "runs", "by", "hills", "and", "towns"]) for _ in range(rng.randint(15, 60))]
        made.append((i, " ".join(words) if truth[i] else " ".join(w.upper() + "!!" for w in words), f"s{i % 5}"))
    labels = spark.createDataFrame([(i, truth[i]) for i in range(0, 400, 4)], "doc_id bigint, quality int")
    got = quality_classifier.scores(documents(spark, made), labels).collect()
    held = [r for r in got if r.doc_id % 4]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97


def test_sums_over_all_unlabelled_documents(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, sum(quality_classifier.DIMS))).astype(np.float32)
    w = [[rng.normal(size=d) for d in quality_classifier.DIMS] for _ in (0, 1)]
    pool = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").repartition(7)
    got = quality_classifier.sure_sums(pool, *w)
    views = quality_classifier.VIEWS
    for v, other in ((0, 1), (1, 0)):
        chance = quality_classifier.sigmoid(x[:, views[other]] @ w[0][other])
        for label, sure in enumerate((chance <= 1 - quality_classifier.SURE, chance >= quality_classifier.SURE)):
            z = x[sure][:, views[v]].astype(float)
            p = quality_classifier.sigmoid(z @ w[1][v])
            n, gradient, curve = got[v][label]
            assert n == sure.sum() > 100
            assert np.allclose(gradient, z.T @ (p - label)) and np.allclose(curve, (z.T * (p * (1 - p))) @ z)


# 3


def test_tokens_edges(spark, edges, nothing, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*((i, t) for i, t, _ in EDGES), (-3, "<|endoftext|> 'll  \n\n x\x85y　z"), (2**40, "far")]
    docs = documents(spark, [(i, t, "a") for i, t in texts])
    manifest = token_output.write_shards(docs, path, scratch_path(spark, "t"))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(rows(token_output.read_shards(manifest)), key=key) == sorted(token_output.brute_force(texts, path), key=key)
    for r in manifest.collect():
        shard = token_output.Shard(r.file)
        ends = shard.ends.run(0, shard.n_docs).tolist()
        assert ends == [shard.ends.select(i) for i in range(shard.n_docs)] and ends[-1] == r.n_ids
        assert all(shard.document(i)[-1] == token_output.END_ID for i in range(shard.n_docs))
    assert rows(token_output.read_shards(token_output.write_shards(nothing, path, scratch_path(spark, "t")))) == []


def test_tokens_keep_the_order_of_files(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(i * 7919 % 101 - 9 if i % 10 else None, f"text {i}") for i in range(100)]
    docs = documents(spark, [(i, t, "a") for i, t in texts])
    docs.coalesce(1).write.option("maxRecordsPerFile", 13).parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    want = token_output.brute_force(texts, path, keep_order=True)
    for some in (docs, docs.coalesce(1), documents(spark, [(i, t, "a") for i, t in texts])):
        manifest = token_output.write_shards(some, path, scratch_path(spark, "t"), keep_order=True)
        assert sorted(rows(token_output.read_shards(manifest)), key=lambda r: r[1]) == want


def test_tokens_of_one_id_spread(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(None if i % 2 else 5, "same" if i % 3 else f"text {i}") for i in range(2000)]
    docs = documents(spark, [(i, t, "a") for i, t in texts])
    manifest = token_output.write_shards(docs, path, scratch_path(spark, "t"))
    got = sorted(rows(token_output.read_shards(manifest)), key=lambda r: r[1])
    assert got == token_output.brute_force(texts, path)
    assert max(r.n_docs for r in manifest.collect()) < 1000


@pytest.mark.parametrize("high", [1, 5, 10**4, 10**12])
def test_elias_fano(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        values = np.sort(rng.integers(0, high, n))
        seq = token_output.EliasFano.of(values)
        assert (seq.run(0, n) == values).all()
        for first in range(0, n, 97):
            assert (seq.run(first, min(n, first + 300)) == values[first : first + 300]).all()
        mixed = token_output.Packed.of(rng.permutation(values).astype(np.uint64))
        assert sorted(mixed.run(0, n)) == values.tolist()
        assert [mixed.select(i) for i in range(0, n, 7)] == mixed.run(0, n)[::7].tolist()
        assert [seq.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    bits = 8 * sum(len(s) for s in seq.sections()) / n
    assert bits <= 3 + np.log2(max(2, high / n)) + 1


def test_new_characters_and_random_text():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, rng = token_output.Encoder(path), random.Random(4)
    alphabet = "ab1 '\n\t.é\u00a0\u3000\u088f\U00010940\U0001df90\u200b\x1c🙂ßk"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    latin = "ab Z9'\n\t\r\x0b\x1cé×÷ñɏÀ¡¿–“…_-.s"
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}!'s" for c in (*range(1, 0x250), *range(0x2000, 0x2030))]
    texts += ["x1 " * 1_500_000 + "\u088f", "yé " * 1_500_000]
    for text in texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, encoder.dtype).tobytes()


def test_added_tokens_are_one_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_output.Encoder(path), Tokenizer.from_file(path)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    mark = "<|endoftext|>"
    for text in (f"a {mark} b", mark, mark * 3, f"x{mark}y\n{mark}\u088f", "<|endoftext", f"é{mark}'s", "a b"):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, encoder.dtype).tobytes()
        want = [(1, 0, len(ids) + 1, zlib.crc32(np.array([*ids, token_output.END_ID], "<u4").tobytes()))]
        assert token_output.brute_force([(1, text)], path) == want


def test_other_tokenizers_encode_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(1, "Hello  World"), (2, "été")]
    manifest = token_output.write_shards(documents(spark, [(i, t, "a") for i, t in texts]), path, scratch_path(spark, "t"))
    assert sorted(rows(token_output.read_shards(manifest))) == token_output.brute_force(texts, path)


# 4


def test_secrets_edges(spark, edges, nothing):
    key = "AKIA" + "A1B2" * 4
    texts = [
        (11, f"Password = 'abcdef123456' {key} deadbeefdeadbeef0", "a"),
        (12, f"Password = 'abcdef123456' {key} deadbeefdeadbeef0", "b"),
        (13, "ſecret: abcdefghijklm paſſword=abcdefghijklm toKen=abcdefghijklm", "a"),
        (11, "api_key:short token=" + "x" * 50_000, "a"),
    ]
    docs = documents(spark, texts).unionByName(edges)
    ledger = scratch_path(spark, "ledger")
    got = secret_scan.scan(docs, ledger).collect()
    assert len(got) == len(texts) + len(EDGES)
    by_text = {t: brute.secrets(t)[3] for _, t, _ in [*texts, *EDGES]}
    own = sorted(brute.digest([(s.kind, s.start, s.end) for s in r.spans if s.kind in secret_scan.BASE_KINDS]) for r in got)
    assert own == sorted(by_text[t] for _, t, _ in [*texts, *EDGES])
    assert rows(secret_scan.scan(nothing, scratch_path(spark, "ledger"))) == []


def test_ledger_scans_only_unseen_pairs(spark):
    seen = spark.sparkContext.accumulator(0)

    def scanner(text):
        seen.add(1)
        return [{"kind": "hex", "start": 0, "end": len(text or "")}]

    docs = documents(spark, [(i, f"text {i % 3}", "a") for i in range(30)])
    ledger = scratch_path(spark, "ledger")
    assert secret_scan.scan(docs, ledger, scanner).count() == 30 and seen.value == 3
    more = docs.unionByName(documents(spark, [(90, "text 1", "a"), (91, "new", "a")]))
    assert secret_scan.scan(more, ledger, scanner).count() == 32 and seen.value == 4
    assert secret_scan.scan(more, ledger, scanner, version=2).count() == 32 and seen.value == 8
    alike = documents(spark, [(1, "alike", "a"), (None, "nameless", "a")] * 50 + [(2, "alike", "a")]).repartition(4)
    again = secret_scan.scan(alike, ledger, scanner).collect()
    assert len(again) == 101 and seen.value == 10 and all(r.spans for r in again)


# 5


def test_labeller_on_held_out_pages():
    model = html_extraction.trained()
    rng = np.random.default_rng(12345)
    extractor = html_extraction.Extractor(model)
    right = total = 0
    for _ in range(150):
        blocks, labels = html_extraction.labelled(html_extraction.sample_page(rng))
        if blocks:
            scores = extractor.judge([blocks])[0]
            right += int(((scores > 0) == np.array(labels, bool)).sum())
            total += len(labels)
    assert right / total > 0.985


def test_gradients_are_right():
    model = html_extraction.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 4, model.p["wf"].shape[0])) * 0.1
    y, lengths = rng.integers(0, 2, (2, 4)).astype(float), np.array([4, 2])
    _, grads = model.gradients(x, y, lengths)
    for name, at in (("uf", (2, 5)), ("wb", (1, 40)), ("bf", (33,)), ("out", (3,)), ("ub", (4, 60))):
        keep, step = model.p[name][at], 1e-3
        model.p[name][at] = keep + step
        up, _ = model.gradients(x, y, lengths)
        model.p[name][at] = keep - step
        down, _ = model.gradients(x, y, lengths)
        model.p[name][at] = keep
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=2e-4)


def shown(page):
    return [b.text for b in html_extraction.blocks(page)]


def test_html_reader_closes_what_is_never_shown():
    text = "<article><p>one two</p><p>three <b>four</b></p></article>"
    want = ["one two", "three four"]
    assert shown(f"<html><head><title>t</title><meta charset=x><link>{text}") == want  # head without an end
    assert shown(f"<head><script>a</script><noscript><p>z</p></noscript>{text}</head>") == want
    assert shown("<head><title>t</title> one two <p>three four") == want
    assert shown("<p>one <script>x</script>two<style>p{}</style></p><p>three<svg><path d=1><text>z</text></svg> four") == want
    assert shown("<p>one <svg/>two</p><svg viewBox='0 0'><g><p>three four</p>") == want
    assert shown("<div><object data=x>fallback <p>z</p></div><p>one two<p>three <canvas>z</canvas>four") == want
    assert shown("<p>one two</p><!-- <p>z</p> --><p>three <!-- z -->four<!-- z <p>z</p>") == want
    assert shown("<p>one two</p><p>three four<script>if (a</b) z") == want
    assert shown("<p title='a > b'>one two</p><p class=\"x>three four</p>") == want
    assert shown("a < b <c") == ["a < b <c"]
    assert shown("<p>a</p><iframe><p>z</p></iframe><p>b<template><p>z</p></template>c") == ["a", "bc"]


@pytest.mark.parametrize("size", [60_000, 70_000, 1_000_000])
def test_html_tags_of_any_length(size):
    state = "{\"h\":\"<p>menu item</p>\" " + "x" * size + "}"
    assert shown(f"<article><p>one</p><div data-state='{state}'><p>two</p></div></article>") == ["one", "two"]
    assert shown(f"<article><p>one</p><div {'a=b ' * (size // 4)}><p>two</p></article>") == ["one", "two"]


def test_html_comments_and_quotes():
    assert shown("<article><p>one</p><!--><p>two</p><!---><p>three</p><!----><p>four<!-- z --!><p>five</article>") == [
        "one", "two", "three", "four", "five",
    ]
    assert shown("<p>a</ p>b</>c<!doctype x>d") == ["abcd"]
    assert shown("<p title=it's>one</p><p title = 'a>b' class=\"x\">two</p>") == ["one", "two"]
    assert shown("<p title=\"a>one</p><p>two</p>") == ["one", "two"]  # a quote without its like
    blocks = html_extraction.blocks("<div data-id='x' ID=Side-Bar class=\"navMenu\" role='a'>t</div>")
    assert [(b.path, b.text) for b in blocks] == [("div .side .bar .nav .menu .a", "t")]


@pytest.mark.parametrize("page", [
    "<p>" + "<a " * 350_000, "<p>" + "<a " * 350_000 + ">", "<p>" + '<a ">"' * 170_000 + ">", "<a '>" * 200_001,
    "<div>" * 100_000 + "</p>" * 100_000, "<!--" * 250_000, "<script " * 125_000, "<script>" * 125_000, "<" * 1_000_000,
    "<p>a" * 50_000, "<svg>" * 200_000, "<!" * 500_000, "<head>" * 150_000 + "x" * 1000,
    "<a b='>" * 140_000, "<a b='>\"" * 120_000, "<a b=\"'>" * 120_000, "<a " + "b='c' " * 160_000 + ">", "<a b" + " " * 500_000 + "=" + " " * 500_000 + ">",
    "<!--" + "--!" * 330_000, "</ " * 330_000 + ">", "<!-->" * 200_000,
])
def test_html_reader_is_linear(page):
    began = time.process_time()
    html_extraction.blocks(page)
    assert time.process_time() - began < 6


def test_html_edges(spark):
    nav = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    para = "The river rose by two metres in the night and the lower town was flooded again."
    pages = [
        (1, "u", None),
        (2, None, ""),
        (3, "u", f"<html><body>{nav}<article><p>A &amp; B&nbsp;&#x43;<p>{para}<br>x</article><footer>&copy; x</footer>"),
        (4, "u", f"<article><p>{para}</p><script>if (a < b) document.write('</p>')</script></article>"),
        (5, "u", "<div" * 2000),
        (6, "u", '<p class="' * 3000),
        (7, "u", f"<article>{'<p>' + para + '</p>' * 2}" * 2000),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extraction.extract(df.unionByName(df.where("page_id = 3"))).collect()}
    assert got[1].text == "" and got[2].text == "" and got[2].n_chars == 0
    assert got[3].text == f"A & B C\n{para} x"
    assert got[4].text == para
    assert got[7].text.count(para) > 1900
    assert rows(html_extraction.extract(df.limit(0))) == []


def test_secret_scan_is_linear():
    for text in (
        "eyJ" * 3_300_000, "eyJ." * 2_000_000, "-----BEGIN " * 300_000, "-----BEGIN " + "PRIVATE KEY " * 100_000, "ghp_" * 1_000_000,
        "xoxa-" * 1_000_000, "secret" + " " * 1_000_000, "token=" * 200_000, "AKIA" * 1_000_000, "deadbeef" * 1_000_000,
    ):
        began = time.process_time()
        secret_scan.spans(text)
        assert time.process_time() - began < 8, text[:12]


def test_jwts_as_their_pattern_finds_them():
    rng = random.Random(3)
    pattern = secret_scan.ADDED["jwt"][1]
    parts = ["eyJ", "a" * 8, "b", ".", ".", "eyJ" + "c" * 8, "-", " ", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert [m.span() for m in pattern.finditer(text)] == list(secret_scan.jwt_spans(text)), text


def test_findings_of_other_runs_blobs_are_left_alone(spark, tmp_path):
    first = documents(spark, [(1, "AKIA" + "A" * 16, "a")])
    second = documents(spark, [(2, "0123456789abcdef0", "a"), (3, "AKIA" + "A" * 16, "a")])
    ledger = str(tmp_path / "ledger")
    assert secret_scan.scan(first, ledger).count() == 1
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.scan(second, ledger).collect()}
    assert got == {2: ["hex"], 3: ["access"]}


def test_token_shards_close_by_documents(spark, monkeypatch, tmp_path):
    import public_tokenizers

    monkeypatch.setattr(token_output, "SHARD_DOCS", 7)
    docs = documents(spark, [(i, None if i % 3 else "word " * i, "a") for i in range(50)])
    manifest = token_output.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path))
    assert sum(r.n_docs for r in manifest.collect()) == 50 and max(r.n_docs for r in manifest.collect()) == 7
    got = sorted(tuple(r) for r in token_output.read_shards(manifest).collect())
    rows = [(i, None if i % 3 else "word " * i) for i in range(50)]
    assert got == token_output.brute_force(rows, public_tokenizers.path("byte_bpe_50k.json"))


def test_kept_order_is_by_part_number(spark, tmp_path):
    import public_tokenizers

    for name, i in (("part-99999-x", 1), ("part-100000-x", 2), ("part-00007-x", 0)):
        documents(spark, [(i, f"text {i}", "a")]).coalesce(1).write.parquet(str(tmp_path / "one" / name))
        file = next((tmp_path / "one" / name).glob("part-*"))
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / f"{name}.parquet")
    docs = spark.read.parquet(str(tmp_path / "all"))
    manifest = token_output.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "out"), keep_order=True)
    got = sorted((r.start, r.doc_id) for r in token_output.read_shards(manifest).collect())
    assert [i for _, i in got] == [0, 1, 2]


# 6


PII_TEXTS = [
    "a@b.c+d@e.f x@y",
    "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 99999999999999999999.1.1.1",
    "+1 (555) 123-4567-) +12 +4912345678x 4111 1111 1111 1111 4111-1111-1111-1111 4",
    "é@b.com 🙂+49 123 456 78 a.b@c..d a@b.c..d @@a@b.c",
    "4" * 3000 + " 1.1.1.1",
    "1." * 20_000,
    "a@b.c " * 3000,
    "+1" * 20_000,
    None,
    "",
]


def test_pii_edges(spark, nothing):
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(PII_TEXTS)] + [(0, PII_TEXTS[0], "b")])
    got = pii.personal_data(docs).collect()
    assert len(got) == len(PII_TEXTS) + 1
    for r in got:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]
        counts = tuple(sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        assert (*counts, brute.digest(base)) == brute.personal(PII_TEXTS[r.doc_id])
    assert rows(pii.personal_data(nothing)) == []


def test_pii_drops_what_overlaps_base_spans(spark, monkeypatch):
    rng = random.Random(7)
    part = lambda: rng.choice(
        ["555-123-4567", "+1 555-123-4567", "(030) 123 4567", "10.0.0.1", "a@b.org", "x (at) y.com", "123-45-6789"]
        + ["4111 1111 1111 1111", "+49 30 123-45-6789", "4111 1111 1111 1111 222-333-4444", "1.2.3.4.555.666.7777", "word", " "]
    )
    made = [(i, rng.choice(["", " ", ", "]).join(part() for _ in range(rng.randint(0, 40))), "a") for i in range(60)]
    docs = documents(spark, made)
    kept = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.document_candidates(docs).collect()}
    monkeypatch.setattr(pii, "overlaps", lambda span, others: F.lit(False))
    dropped = 0
    for r in pii.document_candidates(docs).collect():
        every = [(s.kind, s.start, s.end) for s in r.spans]
        base = [s for s in every if s[0] in pii.BASE_KINDS]
        apart = [s for s in every if s in base or not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        assert kept[r.doc_id] == apart
        dropped += len(every) - len(apart)
    assert dropped > 50


def test_pii_adds_what_labelers_agree_on(spark):
    made = [(i, f"call me on 212-555-{1000 + i} or mail ann{i}@example.org", "a") for i in range(30)]
    made += [(100 + i, f"see table 000-000-{1000 + i} page 1", "a") for i in range(3)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(documents(spark, made)).collect()}
    assert all(got[i] == ["email", "local_phone"] for i in range(30))


# 7


def test_mixing_edges(spark, edges, nothing):
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES)
    sizes = sum(r.size for r in got)
    assert sum(c.words for r in got for c in r.copies) == pytest.approx(1.5 * sizes, abs=3)
    assert all(sum(c.words for c in r.copies) <= 2 * r.size for r in got)
    assert rows(mixing.mix(nothing)) == []


def test_mixing_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    rng = random.Random(2)
    made = [(i, "w " * rng.randint(0, 30), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    got = mixing.mix(documents(spark, made)).collect()
    targets = brute.targets({i: len(t.split()) for i, t, _ in made}, {i: s for i, _, s in made})
    taken, shards = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + sum(c.words for c in r.copies)
        for c in r.copies:
            shards.setdefault(c.shard, set()).add((r.source, c.block))
    assert {s: round(t) for s, t in targets.items()} == taken
    owned = [b for blocks in shards.values() for b in blocks]
    assert len(owned) == len(set(owned)) and len(shards) > 16  # blocks are in one shard each
    drawn = {}
    for source, block in owned:
        drawn.setdefault(source, []).append(block)
    assert all(sorted(places) == list(range(len(places))) for places in drawn.values())  # by quota
    assert max(shards) == len(shards) - 1
    whole = mixing.place(mixing.document_sizes(documents(spark, made)).cache(), whole_documents=True).collect()
    assert all(c.words == r.size for r in whole for c in r.copies)


def test_rows_alike_go_on_as_one_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "ALIKE", 64)
    made = [(None, "a b c d e", "hot")] * 700 + [(i, "w " * (i % 9), "hot" if i % 2 else None) for i in range(200)]
    made += [(None, None, "hot")] * 100
    got = mixing.mix(documents(spark, made)).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in made)
    targets = brute.targets({i: len((t or "").split()) for i, (_, t, _) in enumerate(made)}, {i: s for i, (_, _, s) in enumerate(made)})
    taken = {}
    for r in got:
        own = sum(c.words for c in r.copies)
        assert own <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + own
    assert {s: round(t) for s, t in targets.items()} == taken


@pytest.mark.parametrize("blocks", [1, 2, 3, 64, 1000, 4096])
def test_blocks_are_permuted_one_to_one_and_well(spark, blocks):
    n = F.lit(blocks)
    place = mixing.permuted(F.col("id"), n, mixing.round_keys(F.lit(3), n))
    got = [r[0] for r in spark.range(blocks).select(place).collect()]
    assert sorted(got) == list(range(blocks))
    if blocks >= 64:  # no rotation: neighbours don't stay neighbours
        steps = [(b - a) % blocks for a, b in zip(got, got[1:], strict=False)]
        assert max(map(steps.count, set(steps))) < blocks / 8


def test_splitting_tree_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    blocks = [100, 0, 37, 1]
    df = spark.createDataFrame([(i + 1, b) for i, b in enumerate(blocks)], "source_rank int, blocks bigint")
    quotas = [r.quotas for r in mixing.shard_quotas(df).collect()]
    assert [sum(x) for x in zip(*quotas, strict=True)] == blocks
    sizes = [sum(q) for q in quotas]
    assert max(sizes) - min(sizes) <= 1 and min(map(min, quotas)) >= 0


@pytest.mark.parametrize("good, total, draws", [(5, 10, 4), (0, 9, 3), (9, 9, 3), (50, 1000, 500), (3, 4, 0)])
def test_hypergeometric(spark, good, total, draws):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = [r[0] for r in spark.range(n).select(mixing.hypergeometric(*(F.lit(x) for x in (good, total, draws)), u)).collect()]
    mean = draws * good / total
    var = mean * (1 - good / total) * (total - draws) / max(total - 1, 1)
    assert min(got) >= max(0, draws - (total - good)) and max(got) <= min(good, draws)
    assert np.mean(got) == pytest.approx(mean, abs=0.02) and np.var(got) == pytest.approx(var, rel=0.02, abs=0.01)


# 8


URLS = [None, "", "no scheme", "http://", "http://?x", "HTTP://A.Example.COM/en/x#y", "x://com", "ftp://com/", "a://www.example.com/en/", "a://b.net/fr/x?", "a://net/es", "q://x.y.z/a://b.com/", "a://example.com:80/en/", "a://evilexample.com/en/"]


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"(?:/[^?#]*)?", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    extra = [("block", "org", ""), ("allow", "b.org", "/x"), ("block", "a.b.org", "/"), ("block", "a-b.org", "/x"), ("block", "a.b.org", "/")]
    rules = [*url_filters.QUERY_RULES, *extra]
    urls = [*URLS, "a://a.b.org/x/y", "a://c.b.org/z", "a://a-b.org/x", "a://b.org/xx", "a://zz.org", "a://a.a.b.org/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns(
        {n: F.lit(1) for n in ("key", "lane", "stack", "host", "path", "verdict")}
    )
    got = {r[0]: tuple(r)[1:] for r in url_filters.judge(df, spark.createDataFrame(rules, url_filters.RULE_SCHEMA)).collect()}
    assert got == {i: plain_judge(u, rules) for i, u in enumerate(urls)}
    contrary = [*rules, ("block", "com", "/"), ("allow", "net", "/fr/")]
    some = url_filters.judge(df, spark.createDataFrame(contrary, url_filters.RULE_SCHEMA)).collect()
    want = {i: plain_judge(u, [*rules[1:], ("block", "com", "/")]) for i, u in enumerate(urls)}
    assert {r[0]: tuple(r)[1:] for r in some} == want  # block before allow
    none = url_filters.judge(df, spark.createDataFrame([], url_filters.RULE_SCHEMA)).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}
    assert rows(url_filters.judge(df.limit(0), spark.createDataFrame(rules, url_filters.RULE_SCHEMA))) == []


# 9


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    base = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), base


def test_rules_edges(spark, edges, nothing):
    rng = random.Random(5)
    made = [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "#", "\u00a0", "é ", "\t"]) for _ in range(rng.randint(0, 90))), f"h{i % 3}") for i in range(60)]
    docs = documents(spark, made).unionByName(edges)
    got = sorted(str(r[1:7]) for r in rows(quality_rules.verdicts(docs)))
    assert got == sorted(str(plain_counts(t)) for _, t, _ in [*made, *EDGES])
    assert rows(quality_rules.verdicts(nothing)) == []


def test_bad_hosts_go_and_null_hosts_are_one(spark):
    good = " ".join(f"word{i}" for i in range(20))
    made = [(i, "x y", None) for i in range(60)] + [(100, good, None)] + [(200 + i, good, f"h{i % 7}") for i in range(70)]
    kept = {r.doc_id for r in quality_rules.verdicts(documents(spark, made)).collect() if r.kept}
    assert 100 not in kept and all(200 + i in kept for i in range(70))


# 10


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_simhash_edges(spark, edges, radius):
    found = simhash.near_duplicates(edges.where("doc_id is not null"), radius).collect()
    want = simhash.brute_force([(i, t) for i, t, _ in EDGES if i is not None])
    assert {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found} == want
    assert len(found) == len(EDGES) - 1


def test_simhash_of_nothing_and_null_ids(spark, edges, nothing):
    assert rows(simhash.near_duplicates(nothing)) == []
    got = simhash.near_duplicates(edges).collect()
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(EDGES)


def near_points(n, seed):
    """Fingerprints of some balls that touch, and far ones."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**63, 5, dtype=np.uint64)
    out = [rng.integers(0, 2**63, n // 2, dtype=np.uint64)]
    for c in centers:
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(n // 10)], np.uint64)
        out.append(c ^ flips)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("radius", [0, 1])
def test_links_of_dense_balls_in_chunks(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "LEAF", 16)
    points = near_points(1500, 4)
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    labels = {r.node: r.root for r in simhash.components(simhash.links(prints, radius)).collect()}
    sets = simhash.Union()
    for i, p in enumerate(points):
        for q in points[:i][np.bitwise_count(points[:i] ^ p) <= simhash.RADIUS]:
            sets.join(int(p), int(q))
    want, got = {}, {}
    for p in points.tolist():
        want.setdefault(sets.find(p), set()).add(p)
        own = int(np.uint64(p).view(np.int64))
        got.setdefault(labels.get(own, own), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def test_masks_hold_any_four_bits_within_their_radius():
    rng = np.random.default_rng(1)
    for n in (10, 10**8, 10**10, 10**12):
        for radius in range(simhash.RADIUS + 1):
            masks = simhash.masks_for(n, radius)
            for _ in range(300):
                diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
                assert min((diff & m).bit_count() for m in masks) <= radius


def test_shards_overlap_so_that_every_near_pair_shares_one():
    """Boundaries are met on one side only, and yet no pair within the radius is parted."""
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(0, 2**16, 3000).astype(np.uint64))
    for radius in (0, 1, 2):
        tree = simhash.Tree(points[::3], 0xFFFF, radius, 20)
        assert tree.leaves > 20
        held = {}
        for shard, at in tree.shards(points):
            for i in at.tolist():
                held.setdefault(i, set()).add(shard)
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        assert all(held[i] & held[j] for i, j in np.argwhere(near).tolist())
        assert radius == 0 or sum(map(len, held.values())) > len(points)  # it does overlap


def test_one_hub_joins_apart(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(i, 10_000 + i) for i in range(2, 3000, 3)]
    got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.root for r in got} == {1} and len(got) == len({x for e in edges for x in e})
