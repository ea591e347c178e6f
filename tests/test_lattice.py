"""Lattice operators against NumPy and plain Python on small lattices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.kernels import credit_offsets, cross_offsets, gaussian_taps
from gridloom.operators import components, decision, distance, emission, holdout, metric, normalise, ordered, stencil


def grid(spark, **bands):
    first = next(iter(bands.values()))
    rows = [(r, c, *(b[r, c].item() for b in bands.values())) for r in range(first.shape[0]) for c in range(first.shape[1])]
    return spark.createDataFrame(rows, ["r", "c", *bands])


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", name).collect():
        out[row[0], row[1]] = np.nan if row[2] is None else row[2]
    return out


def convolve(a, taps, axis):
    pad = max(abs(k) for k in taps)
    p = np.pad(a, [(pad, pad) if i == axis else (0, 0) for i in range(2)], mode="edge")
    return sum(t * np.take(p, np.arange(a.shape[axis]) + pad + k, axis) for k, t in taps.items())


def test_kernels():
    assert len(credit_offsets()) == 25
    assert len(cross_offsets(3)) == 25
    assert math.isclose(sum(gaussian_taps(1.5).values()), 1)
    assert abs(sum(gaussian_taps(1.5, 1).values())) < 1e-12


@pytest.mark.parametrize("tile", [1024, 8])
def test_smooth_equals_numpy_in_tiles(spark, tile):
    a = np.random.default_rng(1).random((20, 17))
    got = back(stencil.smooth(grid(spark, v=a), {"g": ("v", 1.0, 0, 1)}, tile), "g", a.shape)
    want = convolve(convolve(a, gaussian_taps(1.0, 0), 0), gaussian_taps(1.0, 1), 1)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_finite_gradient_and_occupancy(spark):
    a = np.random.default_rng(2).random((9, 8))
    g = stencil.finite_gradient(grid(spark, v=a), "v")
    want = np.gradient(a)
    np.testing.assert_allclose(back(g, "fr", a.shape), want[0])
    np.testing.assert_allclose(back(g, "fc", a.shape), want[1])
    m = np.zeros((9, 9), int)
    m[4, :] = 1
    v = back(stencil.occupancy(grid(spark, m=m), "m", 2), "vote", m.shape)
    assert v[4, 4] == 1 and v[4, 0] == 0.6 and v[0, 0] == 0


@pytest.mark.parametrize("density", [0.02, 0.2])
def test_distance_is_exact(spark, density):
    m = np.random.default_rng(3).random((25, 90)) < density
    m[0, 0] = True
    pts = np.argwhere(m)
    rr, cc = np.indices(m.shape)
    want = ((rr[..., None] - pts[:, 0]) ** 2 + (cc[..., None] - pts[:, 1]) ** 2).min(-1)
    got = distance.distance(grid(spark, m=m), F.col("m"), rows=4).persist()
    np.testing.assert_array_equal(back(got, "d2", m.shape), want)
    # of the nearest cells, the one in the least row, then column
    first = pts[((rr[..., None] - pts[:, 0]) ** 2 + (cc[..., None] - pts[:, 1]) ** 2).argmin(-1)]
    np.testing.assert_array_equal(back(got, "fr", m.shape), first[..., 0])
    np.testing.assert_array_equal(back(got, "fc", m.shape), first[..., 1])


def test_distance_on_a_lattice_with_holes(spark):
    rows = [(r, c, (r, c) == (3, 1)) for r in range(6) for c in range(8) if (r + c) % 3]
    got = distance.distance(spark.createDataFrame(rows, "r int, c int, m boolean"), F.col("m")).collect()
    assert all(x.d2 is None or x.d2 == (x.r - 3) ** 2 + (x.c - 1) ** 2 for x in got) and any(x.d2 == 0 for x in got)


def test_nearest_fill_carries_the_value(spark):
    a = np.where(np.random.default_rng(12).random((12, 14)) < 0.1, np.arange(168.0).reshape(12, 14), np.nan)
    df = grid(spark, v=a).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = back(distance.nearest_fill(df, "v", "out"), "out", a.shape)
    pts = np.argwhere(~np.isnan(a))
    rr, cc = np.indices(a.shape)
    near = pts[((rr[..., None] - pts[:, 0]) ** 2 + (cc[..., None] - pts[:, 1]) ** 2).argmin(-1)]
    np.testing.assert_array_equal(got, a[near[..., 0], near[..., 1]])


def test_distance_without_marks_is_null(spark):
    m = np.zeros((4, 4), bool)
    assert distance.distance(grid(spark, m=m), F.col("m")).filter("d2 IS NOT NULL").count() == 0


def test_dilate_erode_are_dual(spark):
    m = np.random.default_rng(4).random((15, 15)) < 0.6
    df = grid(spark, m=m)
    got = {tuple(r) for r in distance.erode(df, "m", 1).select("r", "c").collect()}
    want = {(r, c) for r in range(1, 14) for c in range(1, 14) if all(m[r + i, c + j] for i, j in cross_offsets(1))}
    assert got == want


def flood(m):
    label, k = np.zeros(m.shape, int), 0
    for r, c in np.argwhere(m):
        if label[r, c]:
            continue
        k += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and not label[y, x]:
                label[y, x] = k
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@pytest.mark.parametrize(("tile", "density"), [(512, 0.35), (8, 0.35), (5, 0.6)])
def test_components_number_in_scan_order(spark, tile, density):
    m = np.random.default_rng(5).random((30, 30)) < density
    got = components.components(grid(spark, m=m).filter("m"), tile)
    np.testing.assert_array_equal(np.nan_to_num(back(got, "comp", m.shape)), flood(m))


def greedy(score, spacing):
    taken = []
    for r, c in sorted(np.argwhere(score > 0).tolist(), key=lambda p: (-score[p[0], p[1]], p[0], p[1])):
        if all((r - y) ** 2 + (c - x) ** 2 >= spacing**2 for y, x in taken):
            taken.append((r, c))
    return taken


@pytest.mark.parametrize(("field", "tile", "frame"), [("random", 256, 32), ("ties", 256, 32), ("random", 8, 4), ("ties", 9, 3), ("flat", 8, 5)])
def test_emission_equals_the_sequential_rule(spark, field, tile, frame):
    """Small tiles and frames leave chains open, so several passes are needed; a flat field is one chain."""
    s = np.random.default_rng(6).random((24, 24))
    s = {"random": s, "ties": np.round(s, 1), "flat": np.ones((24, 24))}[field]
    rows = emission.emit(grid(spark, s=s), "s", 2.8, tile, frame).orderBy("rank").collect()
    assert [(r.r, r.c) for r in rows] == greedy(s, 2.8)
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_dti_identities(spark):
    t = np.random.default_rng(7).random((30, 30)) < 0.05
    df = grid(spark, t=t).withColumn("p", F.col("t").cast("double"))
    one = metric.parts(df, "p", "t").first()
    assert one.fp == 0 and one.fn == 0 and one.dti > 0.999
    none = metric.parts(df.withColumn("p", F.lit(0.0)), "p", "t").first()
    assert none.tp == 0 and none.fn == t.sum() and none.dti == 0
    shifted = metric.parts(df.withColumn("p", F.lit(0.5)), "p", "t").first()
    assert math.isclose(shifted.tp + shifted.fn, t.sum())


def test_metric_without_truth(spark):
    df = grid(spark, t=np.zeros((5, 5), bool)).withColumn("p", F.lit(0.25))
    row = metric.parts(df, "p", "t").first()
    assert row.dti == 0 and math.isclose(row.fp, 25 * 0.25)


def test_ranks_and_scaling(spark):
    a = np.random.default_rng(8).integers(0, 5, (10, 10)).astype(float)
    got = back(normalise.rank_unit(grid(spark, v=a), "v", "u", F.lit(True)), "u", a.shape)
    order = np.argsort(a.ravel(), kind="stable")
    want = np.empty(100)
    want[order] = np.arange(100) / 99
    np.testing.assert_allclose(got.ravel(), want)
    flat = normalise.robust_unit(grid(spark, v=np.ones((3, 3))), "v", "u")
    assert flat.agg(F.max("u")).first()[0] == 0


def test_sequential_test_boundaries(spark):
    assert decision.folds_needed() == (9, 5)
    rows = [("w", k, True) for k in range(1, 15)] + [("l", k, False) for k in range(1, 15)]
    out = {r.candidate: r for r in decision.sprt_sign(spark.createDataFrame(rows, "candidate string, k int, win boolean")).collect()}
    assert out["w"].stopped_at == 9 and out["w"].decision == "accept_H1"
    assert out["l"].stopped_at == 5 and out["l"].decision == "accept_H0" and out["l"].total == 14
    with pytest.raises(ValueError):
        decision.bounds(0, 0.1)


def test_quantiles_of_many_values(spark):
    """Beyond 20,000 values quantiles come from brackets; ties, nulls and not-a-numbers included."""
    rng = np.random.default_rng(13)
    v = np.concatenate((rng.random(30_000), np.repeat(0.5, 9_000), rng.random(2_000) * 1e6))
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(4)
    at = [0.0, 0.0002, 0.02, 0.25, 0.5, 0.9, 0.995, 0.99999, 1.0]
    row = normalise.quantiles(df, "v", at).first()
    np.testing.assert_allclose(list(row), np.quantile(v, at), rtol=1e-12)
    assert normalise.quantiles(df.filter("v < 0"), "v", [0.5]).first()[0] is None


def test_ordered_sums_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 1000).alias("k"), F.col("id")).repartition(7)
    rows = ordered.running(ordered.ordered(df, "k", "id"), F.col("id"), "below", "all").collect()
    want, total = {}, 0
    for k, i in sorted((i * 37 % 1000, i) for i in range(5000)):
        want[i] = total
        total += i
    assert {x.id: x.below for x in rows} == want and {x["all"] for x in rows} == {total}


def test_constant_field_has_lift_one_half(spark):
    df = spark.range(50).select(F.lit(1.0).alias("v"), (F.col("id") < 5).alias("t"))
    assert decision.rank_lift(df, "v", "t").first()["lift"] == 0.5
    assert decision.auc(df, "v", "t").first()["auc"] == 0.5


def test_fit_recovers_known_values():
    n = np.array([1000, 3000, 8000, 20000, 40000.0])
    w = np.array([0.3, 0.25, 0.2, 0.15, 0.1])
    tp = 6000 * (1 - np.exp(-2.5 * n * w / 6000))
    k, a, error = decision.fit_saturating(n, w, tp / (0.2 * tp + 0.2 * n + 0.8 * 6000))
    assert error < 1e-3 and abs(k / 6000 - 1) < 0.05


def test_prefix_includes_the_crossing_row(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "k int, size int")
    assert [r.k for r in holdout.prefix_to(df, "size", ["k"], F.lit(5)).orderBy("k").collect()] == [1, 2]


def test_stream_matches_batch(spark, tmp_path):
    from gridloom.streaming.sprt import sprt_stream

    rows = [("a", k, k % 4 != 0) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "candidate string, k int, win boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sprt_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sprt").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("sprt").filter("NOT rejected").orderBy(F.desc("n")).first()
    want = decision.sprt_sign(df).first()
    assert out.n == want.stopped_at and out.decision == want.decision and math.isclose(out.llr, want.llr)


def cover(score, budget):
    """The sequential rule on whole arrays."""
    moves, far = credit_offsets(), 3
    height, width = score.shape
    w = np.pad(score, 2 * far)
    best, out = np.zeros_like(w), []
    while len(out) < budget:
        gain = sum(w[2 * far + i : 2 * far + i + height, 2 * far + j : 2 * far + j + width] * np.maximum(k - best[2 * far + i : 2 * far + i + height, 2 * far + j : 2 * far + j + width], 0) for i, j, k in moves)
        r, c = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
        if gain[r, c] <= 1e-9:
            break
        out.append((int(r), int(c), gain[r, c]))
        for i, j, k in moves:
            at = r + 2 * far + i, c + 2 * far + j
            best[at] = max(k, best[at])
    return out


@pytest.mark.parametrize(("scores", "budget", "tile", "frame", "pool"), [("even", 40, 256, 48, 12), ("even", 60, 16, 13, 1), ("few", 30, 12, 14, 2), ("ring", 12, 256, 48, 12), ("flat", 200, 16, 12, 3), ("free", 10**6, 16, 12, 1)])
def test_max_cover_equals_the_sequential_rule(spark, scores, budget, tile, frame, pool):
    s = np.round(np.random.default_rng(9).random((44, 37)), 1)
    if scores == "few":
        s[s < 0.9] = 0
    if scores == "flat":
        s[:] = 0.5
    if scores == "free":
        s = np.random.default_rng(10).random((44, 37))
    if scores == "ring":  # the best cell has no score of its own
        s[:] = 0
        s[4:7, 4:7] = 0.5
        s[5, 5] = 0
    rows = emission.max_cover(grid(spark, s=s), "s", budget, tile, frame, pool).orderBy("step").collect()
    want = cover(s, budget)
    assert [(x.r, x.c, x.step) for x in rows] == [(r, c, k + 1) for k, (r, c, _) in enumerate(want)]
    np.testing.assert_allclose([x.gain for x in rows], [g for _, _, g in want], atol=1e-9)
