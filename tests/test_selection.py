"""Exact quantiles, distinct counts, samples and term places against plain code."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.functions import text
from tidewarden.operators import profiling, relevance, selection


def values(seed):
    rnd = random.Random(seed)
    kinds = {
        0: lambda: rnd.gauss(0, 1),
        1: lambda: float(rnd.randrange(5)),
        2: lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) * rnd.random(),
        3: lambda: rnd.choice([math.inf, -math.inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 1.0]),
        4: lambda: 1 + rnd.randrange(10**6) * 2.0**-52,
    }
    return [kinds[seed]() for _ in range(3000)]


@pytest.mark.parametrize("seed", range(5))
def test_values_at_ranks(spark, monkeypatch, seed):
    monkeypatch.setattr(selection, "FEW", 10)
    monkeypatch.setattr(selection, "CUTS", 16)
    made = values(seed)
    df = spark.createDataFrame([(v,) for v in [*made, None, math.nan]], "v double")
    ranks = [0, 1, 7, 1499, 1500, 2998, 2999, 5000]
    found = selection.values_at(df, "v", ranks)
    order = sorted(made)
    assert found.pop("n") == 3000 and found.pop(5000) is None
    assert found == {k: order[k] for k in ranks[:-1]}


def test_quantiles_lie_between_values_in_proportion(spark):
    made = values(0)
    df = spark.createDataFrame([(v,) for v in made], "v double")
    at = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)
    assert selection.quantiles(df, "v", at) == pytest.approx(list(np.quantile(made, at)), rel=1e-12)
    assert selection.quantiles(df.limit(0), "v", at) == [None] * 6
    one = spark.createDataFrame([(3,), (None,)], "v int")
    assert selection.quantiles(one, "v", (0.3, 0.9)) == [3.0, 3.0]


def test_distinct_counts_of_all_kinds_of_columns(spark):
    base = dt.datetime(2024, 10, 27, 0, 30)
    rows = []
    for i in range(300):
        rows.append((
            i % 7 or None, -0.0 if i % 2 else 0.0, "x" * (i % 90), None, [i % 3], bytes([i % 5]), base + dt.timedelta(microseconds=i % 11),
            {"a": i % 4}, bool(i % 2), float("nan") if i % 2 else 1.5,
        ))
    df = spark.createDataFrame(rows, "a int, b double, c string, d string, e array<int>, f binary, g timestamp, h struct<a:int>, i boolean, j double")
    got = {r.column_name: (r.missing, r.n_unique) for r in profiling.schema_profile(df).collect()}
    assert got == {
        "a": (43, 6), "b": (0, 1), "c": (0, 90), "d": (300, 0), "e": (0, 3), "f": (0, 5), "g": (0, 11), "h": (0, 4), "i": (0, 2), "j": (0, 2),
    }
    none = {r.column_name: (r.missing, r.missing_percent, r.n_unique) for r in profiling.schema_profile(df.limit(0)).collect()}
    assert set(none.values()) == {(0, 0.0, 0)} and len(none) == 10
    assert tuple(profiling.key_check(df, "a").first()) == (300, 257, 6, 251)
    assert tuple(profiling.key_check(df, "d").first()) == (300, 0, 0, 0)
    assert tuple(profiling.overview(df, ["a", "d"], "a").first()) == (300, 6, 0, 1, 6)


def test_profile_has_one_large_exchange(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as a", "cast(id as string) as b")
    plan = profiling.schema_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("hashpartitioning(place") + plan.count("Exchange hashpartitioning") <= 4


def test_samples_follow_from_md5(spark):
    rows = [(i, f"g{i % 3 if i % 10 else 0}") for i in range(500)] + [(None, "g0")]
    df = spark.createDataFrame(rows, "k int, g string")
    rank = lambda k: hashlib.md5(f"7:{'' if k is None else k}".encode()).hexdigest()
    want = sorted((k for k, _ in rows), key=rank)[:20]
    assert [r.k for r in profiling.sample(df, 20, "k", 7).collect()] == want
    got = {}
    for r in profiling.sample(df.repartition(5), 9, "k", 7, by="g").collect():
        got.setdefault(r.g, set()).add(r.k)
    assert got == {g: set(sorted((k for k, h in rows if h == g), key=rank)[:9]) for g in ("g0", "g1", "g2")}
    some = profiling.sample(df.where("k < 250"), 20, "k", 7).unionByName(profiling.sample(df.where("k >= 250 or k is null"), 20, "k", 7))
    assert {r.k for r in profiling.sample(some, 20, "k", 7).collect()} == set(want)  # samples merge


TEXTS = [
    None, "", "HPAI", "xHPAI hpai", "hpai_ HPAI1 éHPAI HPAI.", "H5N1/H5N5", "geflügelPEST und Gefluegelpest", "Sperrzonen sperrzone", "🙂HPAI🙂 asp",
    "ASṔ aspx Asp", "ſperrzone Kelvin", "AUSBRUCH" * 3, "İHPAI Keulung", "hpai‍ hpai", "Ⓐasp asp", "NEWCASTLE newcastle",
]


def test_one_pass_finds_what_patterns_find(spark):
    terms = [*relevance.TERMS, "Kelvin", "new"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in df.select("t", text.first_places(F.col("t"), terms, relevance.ACRONYMS).alias("a")).collect():
        want = []
        for i, term in enumerate(terms):
            guard = (r"(?<!\w)", r"(?!\w)") if term in relevance.ACRONYMS else ("", "")
            if m := re.search(re.escape(term).join(guard), r.t or "", re.IGNORECASE):
                want.append((i, *m.span()))
        assert [tuple(x) for x in r.a] == want, r.t


def test_thousands_of_terms(spark):
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(2, 6))) for _ in range(4000)]
    body = "".join(rnd.choice("ABCDÉabcdé  ") for _ in range(3000))
    df = spark.createDataFrame([(body,)], "t string")
    found = {p.at: p.start for p in df.select(text.first_places(F.col("t"), terms)).first()[0]}
    low = body.lower()
    assert found == {i: low.find(t) for i, t in enumerate(terms) if t in low}


def test_word_characters():
    assert all(text.is_word(chr(c)) == bool(re.match(r"\w", chr(c))) for c in range(0x110000))
