"""Lengths on the ellipsoid."""

import pytest
from pyspark.sql import functions as F

from waymark.functions.geo import geodesic

# An equatorial degree, a degree of latitude at the equator, and the quarter meridian of WGS84.
KNOWN = [((0.0, 0.0, 1.0, 0.0), 111319.4908), ((0.0, 0.0, 0.0, 1.0), 110574.3886), ((12.0, 0.0, 12.0, 90.0), 10001965.7293), ((179.5, 10.0, -179.5, 10.0), 109639.322), ((5.0, 5.0, 5.0, 5.0), 0.0), ((-10.0, 0.0, 30.0, 0.0), 40 * 111319.4908)]


def test_known_lengths_and_places_without_one(spark):
    rows = [(i, *p) for i, (p, _) in enumerate(KNOWN)] + [(100, None, 0.0, 1.0, 1.0), (101, 0.0, 0.3, 179.8, 0.1)]
    table = spark.createDataFrame(rows, "i long, a double, b double, c double, d double")
    got = {r.i: r.m for r in table.select("i", geodesic(*[F.col(c) for c in "abcd"]).alias("m")).collect()}
    for i, (_, metres) in enumerate(KNOWN):
        assert got[i] == pytest.approx(metres, abs=2e-3)
    assert got[100] is None and got[101] is None  # nearly opposite each other
    back = {r.i: r.m for r in table.select("i", geodesic(*[F.col(c) for c in "cdab"]).alias("m")).collect()}
    assert all(back[i] == pytest.approx(got[i], abs=1e-4) for i in range(len(KNOWN)))
