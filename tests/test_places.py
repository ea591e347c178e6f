"""Nearest neighbours at any distance, grouped emission and the grid of settings, tests under both boundaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import decision, distance, emission, evaluate, metric
from gridloom.operators.neighbours import nearest


def brute_nearest(points, k):
    out = set()
    for r, c in points:
        others = sorted(((r - y) ** 2 + (c - x) ** 2, y, x) for y, x in points if (y, x) != (r, c))[:k]
        out |= {(r, c, i + 1, y, x, d2) for i, (d2, y, x) in enumerate(others)}
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
def test_nearest_equals_brute_force(spark, k):
    """A dense cluster, ties, a line, clusters far apart, and one point far from all."""
    g = np.random.default_rng(k)
    points = {(int(r), int(c)) for r, c in g.integers(0, 9, (50, 2))} | {(300 + int(r), 40) for r in range(0, 40, 3)} | {(-500 + int(r), -700 + int(c)) for r, c in g.integers(0, 40, (20, 2))} | {(9000, 12)}
    df = spark.createDataFrame([*points, *list(points)[:5]], "r int, c int").repartition(3)
    got = [(x.r, x.c, x.place, x.nr, x.nc, x.d2) for x in nearest(df, k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_nearest(points, k)


def test_nearest_of_few_points(spark):
    few = spark.createDataFrame([(0, 0), (3, 4)], "r int, c int")
    assert sorted((x.r, x.c, x.d2) for x in nearest(few, 5).collect()) == [(0, 0, 25), (3, 4, 25)]
    assert nearest(few.limit(1), 2).count() == 0 and nearest(few.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        nearest(few, 0)


def cells_of(spark, seed=5, height=40, width=37):
    g = np.random.default_rng(seed)
    s, t, k = np.round(g.random((height, width)), 2), g.random((height, width)) < 0.06, np.zeros((height, width), bool)
    k[20, 5:30] = True
    rows = [(r, c, float(s[r, c]), bool(t[r, c]), bool(k[r, c])) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "r int, c int, score double, truth boolean, known boolean")


def test_groups_are_emitted_on_their_own(spark):
    """Group numbers of any size; each group as if alone, with a spacing of its own."""
    df = cells_of(spark)
    both = df.withColumn("g", F.lit(3)).unionByName(df.withColumn("g", F.lit(2_000_000_000)).withColumn("score", 1 - F.col("score")))
    got = emission.emit_groups(both, "score", "g", {3: 2.0, 2_000_000_000: 3.5}, tile=16, frame=8).collect()
    for g, spacing, field in ((3, 2.0, df), (2_000_000_000, 3.5, df.withColumn("score", 1 - F.col("score")))):
        alone = {(x.r, x.c, x.rank) for x in emission.emit(field, "score", spacing, tile=16, frame=8).collect()}
        assert {(x.r, x.c, x.rank) for x in got if x.g == g} == alone
    with pytest.raises(ValueError):
        emission.emit(df, "score", 8.5, tile=16, frame=8)


def test_grid_of_settings_equals_runs_of_their_own(spark):
    df = cells_of(spark)
    rows = evaluate.emission_grid(df, "score", F.col("known"), F.col("truth"), [2.0, 3.0], [1.0, 3.0], [5, 40, 10_000]).collect()
    assert len(rows) == 12
    for x in rows:
        allowed = distance.beyond(df, df.filter("known"), int(x.buffer)).filter("NOT known")
        dots = emission.emit(allowed, "score", x.spacing).filter(F.col("rank") <= x.budget)
        marked = df.filter("NOT known").join(dots.select("r", "c", F.lit(1.0).alias("p")), ["r", "c"], "left").fillna(0.0, ["p"])
        want = metric.parts(marked, "p", "truth").first()
        assert (x.n, x.n_truth) == (dots.count(), want.n_truth)
        assert np.allclose((x.tp, x.fp, x.dti), (want.tp, want.fp, want.dti), atol=1e-9)


def test_bounds_over_a_table_of_parameters(spark):
    rows = [(0.05, 0.1, 0.5, 0.7), (0.01, 0.2, 0.4, 0.6), (1.5, 0.1, 0.5, 0.7), (0.05, 0.1, 0.7, 0.7)]
    df = spark.createDataFrame(rows, "alpha double, beta double, p0 double, p1 double")
    for boundary in ("ville", "wald"):
        up, low = decision.bounds_of(F.col("alpha"), F.col("beta"), boundary)
        wins, losses = decision.folds_of(F.col("p0"), F.col("p1"), F.col("alpha"), F.col("beta"), boundary)
        got = df.select(up.alias("u"), low.alias("l"), wins.alias("w"), losses.alias("s")).collect()
        for (a, b, p0, p1), x in zip(rows[:2], got[:2], strict=True):
            assert np.allclose((x.u, x.l), decision.bounds(a, b, boundary)) and (x.w, x.s) == decision.folds_needed(p0, p1, a, b, boundary)
        assert got[2].u is None and got[3].w is None and got[3].u is not None
    decided = spark.createDataFrame([(2.95,), (-2.3,), (0.0,), (2.9,)], "llr double")
    assert [x.other for x in decision.other_boundary(decided).collect()] == ["accept_H1", "accept_H0", "continue", "accept_H1"]
