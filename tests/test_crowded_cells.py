"""Distance joins in crowded places, and places along lines."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions.geo import haversine_m
from waymark.operators import clean, similarity

POINTS = "track_id long, seq long, lon double, lat double"


def made(seed, tracks, points, spread, at=(116.3, 39.95)):
    rng = random.Random(seed)
    rows = []
    for t in range(tracks):
        x, y = at[0] + rng.uniform(-spread, spread), at[1] + rng.uniform(-spread, spread)
        for s in range(points):
            if rng.random() < 0.3:
                x, y = x + rng.uniform(-4e-4, 4e-4), y + rng.uniform(-3e-4, 3e-4)
            rows.append((t, s, round(x, 6), round(y, 6)))
    return rows


def brute(rows, tolerance):
    near = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and None not in (*a, *b) and haversine_m(*a[2:], *b[2:]) <= tolerance:
                near.setdefault((a[0], b[0]), set()).add(a[1])
    return {(a, b): (len(near[a, b]), len(near[b, a])) for a, b in near if a < b}


@pytest.mark.parametrize(("at", "spread"), [((116.3, 39.95), 6e-4), ((10.0, 0.0), 6e-4), ((25.0, -78.0), 2e-3)])
@pytest.mark.parametrize("few", [1, 40, 4096])
def test_counts_against_all_pairs(spark, monkeypatch, at, spread, few):
    monkeypatch.setattr(similarity, "FEW", few)
    rows = made(3, 7, 40, spread, at) + [(50, 0, at[0], at[1]), (51, 0, at[0], at[1]), (52, 0, None, at[1])]
    table = spark.createDataFrame(rows, POINTS)
    want = brute(rows, 50.0)
    got = {(r.a_track, r.b_track): (r.a_hit, r.b_hit) for r in similarity.near_counts(table, None, 50.0).collect()}
    assert got == want and len(want) > 5
    pairs = {(r.a_track, r.b_track): (r.a_hit, r.b_hit) for r in similarity.hits(similarity.near_points(table, None, 50.0)).collect()}
    assert pairs == want
    base = {(r.a_track, r.b_track): (r.a_hit, r.b_hit) for r in similarity.near_counts(table, 3, 50.0).collect()}
    assert base == {(3, b if a == 3 else a): (m, n) if a == 3 else (n, m) for (a, b), (m, n) in want.items() if 3 in (a, b)}


def test_a_crowded_cell_costs_rows_for_pairs_of_tracks(spark, monkeypatch):
    """Ten tracks of n points in one cell: rows written do not follow n, and n squared pairs are never made."""
    seen = {}
    rows = []

    def counted(df, name, real=similarity.materialize):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    for n in (500, 2000):
        rng = random.Random(n)
        table = spark.createDataFrame([(t, s, 116.3 + rng.uniform(0, 6e-4), 39.95 + rng.uniform(0, 4e-4)) for t in range(10) for s in range(n)], POINTS)
        rows.clear()
        got = similarity.near_counts(table, None, 50.0)
        assert got.count() == 45
        seen[n] = sum(c for name, c in rows if name != "cut-points")
    assert seen[2000] < 5 * seen[500] and seen[2000] < 0.05 * (10 * 2000) ** 2 / 2


def test_places_along_lines(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 14.0), (2, 0, 7.0, 7.0), (3, 0, 1.0, 1.0), (3, 1, 1.0, 1.0), (4, 0, None, 1.0), (5, 2, 2.0, 0.0), (5, 1, 0.0, 0.0), (5, 3, None, None), (5, 4, 4.0, 0.0)]
    table = spark.createDataFrame(rows, POINTS)
    got = {(r.track_id, r.fraction): (r.lon, r.lat) for r in clean.interpolated(table, [0.0, 0.2, 1 / 3, 0.5, 1.0]).collect()}
    assert got[1, 0.0] == (0.0, 0.0) and got[1, 1.0] == (3.0, 14.0) and got[1, 0.2] == pytest.approx((1.8, 2.4)) and got[1, 1 / 3] == pytest.approx((3.0, 4.0)) and got[1, 0.5] == pytest.approx((3.0, 6.5))
    assert {k for k in got if k[0] in (2, 3)} == {(t, f) for t in (2, 3) for f in (0.0, 0.2, 1 / 3, 0.5, 1.0)} and got[2, 0.5] == (7.0, 7.0) and got[3, 0.2] == (1.0, 1.0)
    assert got[5, 0.5] == pytest.approx((2.0, 0.0)) and not any(t == 4 for t, _ in got) and len(got) == 20
    for bad in ([-0.1], [1.1], [float("nan")], []):
        with pytest.raises(ValueError):
            clean.interpolated(table, bad)


def test_memory_follows_neither_far_tracks_nor_sizes_on_disk(spark, monkeypatch):
    """With a baseline only points in the cells around it are written; without one no table is sent through the driver."""
    wrote, plans = {}, []

    def noted(df, name, real=similarity.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = real(df, name)
        wrote.setdefault(name, out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", noted)
    rows = made(4, 3, 20, 3e-4) + made(5, 40, 20, 3e-4, at=(10.0, 50.0))
    table = spark.createDataFrame([(t + 100 * (x < 100), *r, x, y) for t, *r, x, y in rows], POINTS)
    near = similarity.scores(table, 0, 50.0).count()
    assert near == len({b if a == 0 else a for a, b in brute([r for r in rows if r[2] > 100], 50.0) if 0 in (a, b)})
    assert wrote["cut-points"] <= 60
    plans.clear()
    found = similarity.scores(table, None, 50.0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() > 100 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_rows_follow_places_and_words_not_pairs_of_tracks(spark, monkeypatch):
    """Tracks of one way, several words of them: what is written does not grow with the square of the tracks."""
    rows, wrote = [], {}

    def counted(df, name, real=similarity.materialize):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    for n in (40, 160):
        rng = random.Random(n)
        ids = rng.sample(range(-500, 500), n)
        way = [(t, s, 116.3 + 4e-4 * ((t + rng.choice([s, s, s // 2])) % 9), 39.95) for t in ids for s in range(8)]
        rows.clear()
        got = {(r.a_track, r.b_track): (r.a_hit, r.b_hit, r.a_n, r.b_n) for r in similarity._all_pairs(spark.createDataFrame(way + [(ids[0], 8, None, 1.0)], POINTS), 50.0, False).collect()}
        size = lambda t, first=ids[0]: 8 + (t == first)
        assert got == {(a, b): (m, k, size(a), size(b)) for (a, b), (m, k) in brute(way, 50.0).items()} and len(got) > n * n / 3
        wrote[n] = sum(c for _, c in rows)
    assert wrote[160] < 5 * wrote[40]
