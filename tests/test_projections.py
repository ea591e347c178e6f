"""Projections against what defines them, datum shifts there and back, quantiles of tied bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import projections as P
from gridloom.operators import normalise

POINTS = [(-117.0, 0.0), (-117.0, 38.5), (-119.25, 36.75), (-114.0, 42.0), (-120.9, 35.1), (-117.5, -20.0), (-105.0, 60.0)]


def project(spark, to, points):
    rows = P.project(spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "k int, lon double, lat double"), to, "lon", "lat").orderBy("k").collect()
    return np.array([(r.east, r.north) for r in rows])


def test_transverse_mercator_is_conformal_and_true_on_the_meridian(spark):
    """That, and symmetry, is its definition; a published point, to its metre, on top."""
    zone = P.utm(11)
    lats = [0.0, 10.0, 38.5, 60.0]
    arc = [0.9996 * float(P._meridian(P.WGS84, np.array(math.radians(x)))) for x in lats]
    on = project(spark, zone, [(-117.0, x) for x in lats])
    assert np.allclose(on[:, 0], 500_000, atol=1e-9) and np.allclose(on[:, 1], arc, atol=1e-6)
    h = 1e-5
    for lon, lat in POINTS[2:]:
        a = project(spark, zone, [(lon + h, lat), (lon - h, lat), (lon, lat + h), (lon, lat - h)])
        e2, phi = P.WGS84.e2, math.radians(lat)
        w = 1 - e2 * math.sin(phi) ** 2
        east = (a[0] - a[1]) / (P.WGS84.a / math.sqrt(w) * math.cos(phi))
        north = (a[2] - a[3]) / (P.WGS84.a * (1 - e2) / w**1.5)
        assert np.allclose(east, [north[1], -north[0]], rtol=1e-6, atol=1e-9)
    tower = project(spark, P.utm(17), [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)])[0]
    assert abs(tower[0] - 630_084) < 1 and abs(tower[1] - 4_833_438) < 1


def test_albers_keeps_areas_and_its_parallels(spark):
    to = P.Albers(37.5, -117.0, 29.5, 45.5)
    h, e2, a = 1e-4, P.GRS80.e2, P.GRS80.a
    assert np.allclose(project(spark, to, [(-117.0, 37.5)]), 0, atol=1e-6)
    for lon, lat in [(-117.0, 29.5), (-110.0, 45.5), (-121.0, 38.0), (-100.0, 25.0)]:
        p = project(spark, to, [(lon + h, lat), (lon - h, lat), (lon, lat + h), (lon, lat - h)])
        phi = math.radians(lat)
        w = 1 - e2 * math.sin(phi) ** 2
        d = math.radians(2 * h)
        x, y = p[0] - p[1], p[2] - p[3]
        cell = a / math.sqrt(w) * math.cos(phi) * d * a * (1 - e2) / w**1.5 * d
        assert math.isclose(abs(x[0] * y[1] - x[1] * y[0]), cell, rel_tol=1e-6)
        if lat in (29.5, 45.5):
            assert math.isclose(math.hypot(*x), a / math.sqrt(w) * math.cos(phi) * d, rel_tol=1e-7)


@pytest.mark.parametrize("to", [P.utm(11), P.utm(11, True), P.Albers(37.5, -117.0, 29.5, 45.5), P.Albers(-20.0, -117.0, -10.0, -30.0)])
def test_there_and_back(spark, to):
    points = POINTS if isinstance(to, P.TransverseMercator) else POINTS[1:]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)] + [(99, None, 1.0)], "k int, lon double, lat double")
    there = P.project(df, to, "lon", "lat")
    back = P.unproject(there.drop("lon", "lat"), to, "east", "north").orderBy("k").collect()
    assert np.allclose([(r.lon, r.lat) for r in back[:-1]], points, atol=1e-9) and back[-1].lon is None


def test_datum_shift(spark):
    """No shift between equal ellipsoids changes nothing; a shift and its opposite cancel; a move along the axis moves the equator east."""
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(POINTS)], "k int, lon double, lat double")
    rows = lambda d: np.array([(r.lon, r.lat) for r in d.orderBy("k").collect()])
    assert np.allclose(rows(P.shift_datum(df, "lon", "lat", P.WGS84, P.WGS84, (0, 0, 0))), POINTS, atol=1e-9)
    there = P.shift_datum(df, "lon", "lat", P.CLARKE66, P.WGS84, (-8.0, 160.0, 176.0))
    assert np.allclose(rows(P.shift_datum(there, "lon", "lat", P.WGS84, P.CLARKE66, (8.0, -160.0, -176.0))), POINTS, atol=2e-4) and np.abs(rows(there) - POINTS).max() > 1e-4
    one = P.shift_datum(spark.createDataFrame([(0, 0.0, 0.0)], "k int, lon double, lat double"), "lon", "lat", P.WGS84, P.WGS84, (0, 100.0, 0)).first()
    assert math.isclose(one.lon, math.degrees(math.atan2(100, P.WGS84.a)), rel_tol=1e-9)
    turned = P.shift_datum(spark.createDataFrame([(0, 10.0, 0.0)], "k int, lon double, lat double"), "lon", "lat", P.WGS84, P.WGS84, (0, 0, 0), (0, 0, 3600.0 / 100))
    assert math.isclose(turned.first().lon, 10.01, abs_tol=1e-8)


def test_quantiles_of_a_tied_band_gather_little(spark):
    """A band that is mostly one value, over the size that is its own bracket."""
    df = spark.range(200_000).select((F.when(F.col("id") % 10 < 9, 0.0).otherwise((F.col("id") * 7919 % 200_000).cast("double"))).alias("v"))
    x = np.array([0.0 if i % 10 < 9 else float(i * 7919 % 200_000) for i in range(200_000)])
    at = [0.0, 0.02, 0.5, 0.8999, 0.9, 0.90001, 0.95, 0.995, 1.0]
    got = normalise.quantiles(df, "v", at).first()
    assert np.allclose(list(got), np.quantile(x, at), rtol=0, atol=1e-9)
    plan = normalise.quantile_row(df, {"q": ("v", 0.5)})
    assert plan.first().q == 0.0
