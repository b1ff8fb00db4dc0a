"""Collocations against plain counting, on edges and with counters too few to prune."""

import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import documents
from tidewarden.llm import collocations

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=30, longest=4, first=2000, cover=80):
    """The result for rows (lang, text), by counting every phrase."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    own = counts.setdefault(lang, Counter())
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        candidates = [p for p, a in own.items() if len(p) > 1 and a >= least]
        covered = set()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * own[p] >= cover * own[p[i : i + k]]:
                        covered.add(p[i : i + k])
        found = []
        for p in set(candidates) - covered:
            a = own[p]
            score, _, x, y = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, totals[lang], -score))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).select(*NAMES).collect())


def corpus(seed, n=400, vocabulary=12):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ſ", "K", "New", "YORK", "\x00", "a-b", "'s", "🙂"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", ";", ":", "!?", "\x0b", "\x85", "\xa0"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(marks[:3] * 6 + marks) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "de", None, "und", ""]), text))
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "lang string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("phrase", "n", "k", "a", "rank", "words", "place", "block")})


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_equals_plain_counts(spark, most):
    rows = corpus(1) + [("en", None), (None, ""), ("de", " . , "), ("en", "new york " * 500)] + corpus(2, 50) * 2
    assert got(frame(spark, rows), most_buckets=most) == plain(rows)


def test_other_parameters(spark):
    rows = corpus(3, 150)
    options = {"least": 4, "longest": 3, "first": 7, "cover": 60}
    assert got(frame(spark, rows), **options) == plain(rows, **options)


def test_ties_stand_by_score_frequency_and_bytes(spark):
    rows = [("en", "b1 b2. a1 a2. ￿ p. \U0001f642 q. ")] * 30
    found = got(frame(spark, rows))
    assert found == plain(rows)
    assert [r[2] for r in found] == sorted((r[2] for r in found), key=str.encode)


def test_one_long_text_and_many_languages(spark):
    rows = [("en", "the cat sat " * 40_000)] + [(f"l{i}", "one two three. " * 30) for i in range(150)]
    found = got(frame(spark, rows))
    assert found == plain(rows)
    assert len({r[0] for r in found}) == 151


def test_no_rows(spark, nothing):
    assert got(nothing) == []
    assert got(documents(spark, [(1, None, None), (2, "", "a")])) == []
