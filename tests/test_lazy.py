"""Features of single cells against the whole stencil; what a scan reads for them; openness between cells."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import lazy, stencil


def lattice_of(spark, height=150, width=140, seed=1):
    g = np.random.default_rng(seed)
    a, b = g.random((height, width)), g.random((height, width))
    rows = [(r, c, float(a[r, c]), float(b[r, c]) if (r, c) not in ((70, 70), (3, 3)) else None) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "r int, c int, a double, b double"), a


def test_features_at_points_equal_the_whole_stencil(spark):
    """Corners, edges, tile borders, a hole in a band, repeated points and points outside of the lattice."""
    df, _ = lattice_of(spark)
    points = [(0, 0), (149, 139), (0, 77), (63, 64), (64, 63), (70, 71), (72, 70), (4, 4), (100, 20), (100, 20), (500, 3), (-4, 0)]
    at = spark.createDataFrame(points, "r int, c int")
    whole = {(x.r, x.c): x for x in stencil.smooth(df, {"s": ("a", 2.0, 0, 0), "t": ("b", 1.0, 0, 0)}).collect()}
    got = lazy.smoothed_at(df, at, {"a": ("a", 0.0), "s": ("a", 2.0), "t": ("b", 1.0)}, tile=32).collect()
    inside = {p for p in points if p in whole}
    assert {(x.r, x.c) for x in got} == inside and len(got) == len(inside)
    for x in got:
        w = whole[x.r, x.c]
        assert x.a == w.a and x.s == w.s and x.t == w.t
    assert any(x.t is None for x in got)
    assert lazy.smoothed_at(df, at.limit(0), {"s": ("a", 2.0)}).count() == 0


def test_a_scan_reads_only_what_points_reach(spark, tmp_path):
    df, _ = lattice_of(spark, 640, 40)
    df.withColumn("band", F.floor(F.col("r") / 64)).repartitionByRange(10, "r").sortWithinPartitions("r").drop("band").write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    at = spark.createDataFrame([(200, 5), (201, 30)], "r int, c int")
    near = lazy.reached(cells, at, 8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(r,184)" in plan and "LessThanOrEqual(r,263)" in plan
    assert {x.r for x in near.select("r").distinct().collect()} == set(range(184, 264))
    assert lazy._ranges([0, 1, 5], 64, 8) == [(-8, 135), (312, 391)] and len(lazy._ranges(list(range(0, 4000, 2)), 64, 3)) == lazy.RANGES


def test_openness_between_cells(spark):
    df, a = lattice_of(spark, 40, 37, 3)
    p = np.pad(a, 4, mode="edge")
    up, down = np.zeros_like(a), np.zeros_like(a)
    for k in range(8):
        dy, dx = -3 * math.sin(2 * math.pi * k / 8), 3 * math.cos(2 * math.pi * k / 8)
        i, j = math.floor(dy + 1e-12), math.floor(dx + 1e-12)
        fy, fx = max(dy - i, 0), max(dx - j, 0)
        at = lambda u, v: p[4 + u : 4 + u + 40, 4 + v : 4 + v + 37] if 4 + u + 40 <= p.shape[0] and 4 + v + 37 <= p.shape[1] else 0.0
        s = (1 - fy) * ((1 - fx) * at(i, j) + fx * at(i, j + 1)) + fy * ((1 - fx) * at(i + 1, j) + fx * at(i + 1, j + 1))
        up, down = np.maximum(up, np.arctan2(s - a, 3)), np.maximum(down, np.arctan2(a - s, 3))
    for tile in (16, 512):
        got = {(x.r, x.c): x.asym for x in stencil.openness_asymmetry(df, "a", tile=tile).collect()}
        assert len(got) == a.size and all(abs(v - (up - down)[k]) < 1e-9 for k, v in got.items())
