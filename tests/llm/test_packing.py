"""Packing: every id once, sequences full, the least squares plan by its optimality conditions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.conftest import EDGES, documents
from tidewarden.llm import packing, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    own = Tokenizer.from_file(PATH)
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, texts, encode, sequence=1024):
    """Rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset) hold each document's ids
    once, and sequences are gapless and full or a power of two."""
    pieces = {}
    for doc_id, start, length, check_sum, total, *_ in rows:
        pieces.setdefault(doc_id, []).append((start, length, check_sum, total))
    want = {}
    for doc_id, text in texts:
        want.setdefault(doc_id, []).append(encode(text))
    assert set(pieces) == set(want)
    for doc_id, documents_of in want.items():
        own = sorted(pieces[doc_id])
        if len(documents_of) == 1:
            ids, at = documents_of[0], 0
            for start, length, check_sum, total in own:
                assert start == at and total == len(ids) and check_sum == crc(ids[at : at + length])
                at += length
            assert at == len(ids)
        else:
            assert sum(x[1] for x in own) == sum(map(len, documents_of))
    places = {}
    for *_, length, _, _, sequence_id, offset in ((r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows):
        places.setdefault(sequence_id, []).append((offset, length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= sequence and at & (at - 1) == 0
    assert sorted(places) == list(range(len(places)))
    return len(places)


def fields(df):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return [tuple(r) for r in df.select(*names).collect()]


def with_crc(df):
    from pyspark.sql import functions as F

    return df.withColumn("ids_crc32", F.crc32("ids"))


def test_query_holds_every_id_once(spark, small_docs, encode):
    rows = fields(registry.queries()["op12_packing"](spark, SMALL))
    check(rows, small_docs, encode)


def test_few_documents_are_cut(spark, oracle):
    """Documents shorter than a sequence mostly stay whole, though few short ones are there to fill up."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "substring(text, 1, 1500) as text")
    rows = fields(with_crc(packing.pack(docs, PATH)))
    whole = sum(r[2] == r[4] for r in rows)
    assert whole > 0.75 * len({r[0] for r in rows if r[4] <= 1024})
    assert sum(r[2] for r in rows) == sum({r[0]: r[4] for r in rows}.values())


@pytest.mark.parametrize("sequence", [2, 64, 1024])
def test_edges(spark, edges, encode, sequence):
    rows = fields(with_crc(packing.pack(edges, PATH, sequence)))
    check(rows, [(i, t) for i, t, _ in EDGES], encode, sequence)


def test_documents_of_one_length(spark, encode):
    texts = [(i, "same words in every text " * 20) for i in range(400)]
    rows = fields(with_crc(packing.pack(documents(spark, [(*t, "a") for t in texts]), PATH)))
    check(rows, texts, encode)


def test_empty_table_and_wrong_sequence(spark, nothing):
    assert packing.pack(nothing, PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(nothing, PATH, 1000)


def test_sequences_hold_the_ids_of_their_pieces(spark, encode):
    texts = [(i, "some words " * (i * 7 % 150)) for i in range(200)]
    df = documents(spark, [(*t, "a") for t in texts])
    packed = packing.pack(df, PATH, 256)
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    got = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert got == {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()}
    assert all(len(x) in {4 << k for k in range(9)} for x in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_meet_the_optimality_conditions(seed):
    rnd = np.random.default_rng(seed)
    histogram = np.zeros(65, np.int64)
    some = rnd.choice(np.arange(1, 64), rnd.integers(3, 64), replace=False)
    histogram[some] = rnd.integers(1, 5000, len(some))
    columns = packing.combinations(histogram)
    want = [(a, b, c) for a in range(65) for b in range(max(a, 1), 65) for c in range(b, 65) if a + b + c == 64]
    want = [w for w in want if all(x == 0 or histogram[x] for x in w) and w[2] < 64]
    assert sorted(map(tuple, columns.tolist())) == sorted(want)
    if not len(columns):
        return
    solver = packing.LeastSquares(histogram, columns)
    found = solver.solve()
    x = np.zeros(len(columns))
    x[list(found)] = list(found.values())
    counts = np.stack([solver.counts(j) for j in range(len(columns))])
    target = histogram.astype(float)
    target[0] = 0
    gradient = counts @ (target - x @ counts)
    tolerance = max(1.0, packing.TOLERANCE * target.sum() / np.count_nonzero(target))
    assert (x >= 0).all() and len(found) <= 64
    assert gradient.max() <= tolerance + 1e-3
    assert np.abs(gradient[x > 0]).max(initial=0) < 1e-3


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    rnd = random.Random(seed)
    histogram = np.zeros(129, np.int64)
    for length in rnd.sample(range(1, 129), rnd.randint(1, 128)):
        histogram[length] = rnd.choice([1, 2, 5, 300, 40_000])
    plan = packing.Plan(histogram)
    own = {}
    for length, first, last, *_ in plan.ranges:
        own.setdefault(length, []).append((first, last))
    for length, n in enumerate(histogram.tolist()):
        at = 0
        for first, last in sorted(own.get(length, [])):
            assert first == at and last > first
            at = last
        assert at == n
    assert len(plan.ranges) < 128 * 40
