import numpy as np
import pytest

from tidewarden.operators import concepts


def frame(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} {names[1]}, embedding array<double>")


@pytest.mark.parametrize("kind", ["spread", "clusters", "hot"])
def test_equals_comparison_with_every_concept(spark, monkeypatch, kind):
    monkeypatch.setattr(concepts, "BLOCK", 50)
    rng = np.random.default_rng(3)
    if kind == "spread":
        c, v = rng.normal(size=(500, 6)), rng.normal(size=(300, 6))
    elif kind == "clusters":
        base = rng.normal(size=(12, 16))
        c = base[rng.integers(0, 12, 600)] + rng.normal(0, 0.05, (600, 16))
        v = base[rng.integers(0, 12, 300)] + rng.normal(0, 0.05, (300, 16))
    else:  # a third of all in one place
        c, v = rng.normal(size=(400, 4)), rng.normal(size=(300, 4))
        c[:150], v[:100] = c[0], c[0] * 3
    rows = [(f"c{i:04d}", x.tolist()) for i, x in enumerate(c)]
    got = concepts.nearest_concepts(frame(spark, list(enumerate(v.tolist())), ("id", "bigint")), frame(spark, rows, ("name", "string")), cells=16)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(v) @ unit(c).T
    for r in got.collect():
        assert r.similarity == pytest.approx(s[r.id].max(), abs=1e-9)
        assert int(r.concept[1:]) == int((s[r.id] >= s[r.id].max() - 1e-12).argmax())
    assert got.count() == 300


def test_edges(spark):
    some = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("b", [0.0, 2.0]), ("zero", [0.0, 0.0]), ("none", None), (None, [1.0, 0.0]), ("long", [1.0, 0.0, 0.0])]
    asked = [(1, [3.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    v, c = frame(spark, asked, ("id", "int")), frame(spark, some, ("name", "string"))
    got = sorted(((r.id, r.concept) for r in concepts.nearest_concepts(v, c).collect()), key=str)
    assert got == sorted([(1, "a"), (2, None), (3, None), (4, None), (5, None), (6, "a"), (6, "a"), (7, None), (8, None)], key=str)
    assert {r.concept for r in concepts.nearest_concepts(v, c.limit(0)).collect()} == {None}
    assert concepts.nearest_concepts(v.limit(0), c).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_blocks_and_cells(spark, monkeypatch, kind):
    for name, value in {"LEAST": 20, "BLOCK": 37, "PRODUCT": 400, "HELD_BYTES": 1 << 12, "PACKED_BYTES": 1 << 11}.items():
        monkeypatch.setattr(concepts, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 8))
    c = (base[rng.integers(0, 9, 500)] + rng.normal(0, 0.1, (500, 8))).astype(np.float32)
    c[100:180] = c[0]  # copies: the least name
    v = np.concatenate([c[:150] * 2, rng.normal(size=(150, 8)).astype(np.float32)])
    rows, asked = [(f"c{i:04d}", x.tolist()) for i, x in enumerate(c)], list(enumerate(v.tolist()))
    cast = lambda df: df.withColumn("embedding", df["embedding"].cast(f"array<{kind}>"))
    got = concepts.nearest_concepts(cast(frame(spark, asked, ("id", "bigint"))), cast(frame(spark, rows, ("name", "string")))).collect()
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = unit(v) @ unit(c).T
    assert sorted(r.id for r in got) == list(range(300))
    for r in got:
        assert r.similarity == pytest.approx(s[r.id].max(), abs=1e-9)
        assert int(r.concept[1:]) == int((s[r.id] >= s[r.id].max() - 1e-12).argmax())


def test_disk_grows_with_rows_where_all_cells_are_open(spark, monkeypatch, tmp_path):
    """Vectors of many numbers: a copy for each open cell took 7.6 times the input here."""
    monkeypatch.setattr(concepts, "LEAST", 50)
    monkeypatch.setattr("tidewarden.storage.shared_folder", lambda spark: f"file://{tmp_path}/shared")
    x = np.random.default_rng(7).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<float>")
    named = df.selectExpr("cast(id as string) as name", "reverse(embedding) as embedding")
    assert concepts.nearest_concepts(df, named, cells=50).count() == 3000
    assert sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet")) < 5 * x.nbytes


def test_infinite_and_extreme_numbers(spark):
    some = [("inf", [float("inf"), 1.0]), ("huge", [1e300, 1e300]), ("tiny", [0.0, 1e-300])]
    asked = [(1, [1.0, 1.0]), (2, [0.0, 5.0]), (3, [float("-inf"), 0.0])]
    found = concepts.nearest_concepts(frame(spark, asked, ("id", "int")), frame(spark, some, ("name", "string")))
    assert {(r.id, r.concept) for r in found.collect()} == {(1, "huge"), (2, "tiny"), (3, None)}
