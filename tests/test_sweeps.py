import random

import pytest

from tidewarden.operators import joins, sweeps


def tables(spark, seed, n=400, m=60):
    rnd = random.Random(seed)
    spread = (5, 1000)[seed % 2]
    points = [(i, None if rnd.random() < 0.05 else float(rnd.randrange(-5, spread)) / rnd.choice([1, 2])) for i in range(n)]
    points += [(n + i, 3.0) for i in range(n)]  # a place with half of all points
    ways = [(j, None if rnd.random() < 0.05 else float(rnd.randrange(spread)), rnd.random()) for j in range(m)]
    p = spark.createDataFrame(points, "id int, t double").repartition(3)
    w = spark.createDataFrame(ways, "i int, at double, v double")
    return points, [x for x in ways if x[1] is not None], p, w


def least_of_place(ways):
    out = {}
    for i, at, v in sorted(ways, key=lambda x: (x[1], x[0], x[2])):
        out.setdefault(at, (i, at, v))
    return sorted(out.values(), key=lambda x: x[1])


@pytest.mark.parametrize("seed", range(4))
def test_as_of(spark, seed):
    points, ways, p, w = tables(spark, seed)
    own = least_of_place(ways)
    for before in (False, True):
        got = {r.id: r.waypoint and r.waypoint.i for r in sweeps.as_of(p, w, "t", "at", before).collect()}
        for i, t in points:
            fits = [x for x in own if t is not None and (x[1] < t if before else x[1] <= t)]
            assert got[i] == (fits[-1][0] if fits else None)
    assert len(got) == len(points)


@pytest.mark.parametrize("seed", range(4))
def test_nearest_and_piecewise(spark, seed):
    points, ways, p, w = tables(spark, seed)
    own = least_of_place(ways)
    got = {r.id: r.waypoint and r.waypoint.i for r in sweeps.nearest(p, w, "t", "at", "i").collect()}
    for i, t in points:
        want = None if t is None else min(((abs(t - at), j) for j, at, _ in own))[1]
        assert got[i] == want, (i, t)
    got = {r.id: r.path_value for r in sweeps.piecewise(p, w, "t", "at", "v").collect()}
    least: dict = {}
    for _, at, v in ways:
        least[at] = min(least.get(at, v), v)
    pairs = sorted(least.items())
    known = spark.createDataFrame([x for x in points if x[1] is not None], "id int, t double")
    want = {r.id: r.path_value for r in joins.piecewise(known, pairs).collect()}
    assert {i: v for i, v in got.items() if i in want} == pytest.approx(want)
    assert all(v is None for i, v in got.items() if i not in want)


def test_without_waypoints_or_points(spark):
    _, _, p, w = tables(spark, 0, 20, 5)
    assert {r.waypoint for r in sweeps.as_of(p, w.limit(0), "t", "at").collect()} == {None}
    assert {r.waypoint for r in sweeps.nearest(p, w.limit(0), "t", "at", "i").collect()} == {None}
    assert sweeps.as_of(p.limit(0), w, "t", "at").count() == 0
    one = w.limit(1)
    assert {r.path_value for r in sweeps.piecewise(p.where("t is not null"), one, "t", "at", "v").collect()} == {one.first().v}
