"""Centroid clustering against brute force: pruning in few dimensions, whole runs with ties, repeated ids, nulls, other lengths, and numbers beyond 64 bits."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm import kd_means

SCHEMA = "vec_id long, embedding array<double>, cluster string, c int, distance string"


def brute(rows, dim, count, rounds, scale=1024):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cents = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[2]))[:count]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cents)), key=lambda j: (far(v, cents[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v, _ in kept]
        for j in range(len(cents)):
            mine = [v for (_, v, _), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, near(v), far(v, cents[near(v)])) for i, v, _ in kept]
    fits = lambda d: d if d is not None and d < 1 << 63 else None
    total = lambda some: fits(sum(some)) if all(d < 1 << 63 for d in some) else None
    return sorted(((i, j, fits(d), total([e for _, k, e in out if k == j]), total([e for *_, e in out]), sha(",".join(map(str, cents[j])))) for i, j, d in out), key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in kd_means.cluster_vectors(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("dim", [1, 2, 3, 8])
@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_filtering_equals_brute_force(dim, kind):
    """Assignments and sums of a tree, with grids that are full of ties."""
    rng = np.random.default_rng(dim)
    for step in range(20):
        x = rng.integers(-5, 6, (rng.integers(1, 900), dim)) * (1 if step % 2 else 37)
        row = next(kd_means._stored(kd_means.pa.array(range(len(x))), x.astype(float), 1))
        c = x[rng.integers(0, len(x), 8)] + rng.integers(-1, 2, (8, dim))
        tree = kd_means.Tree(row, dim)
        whole, owner, leaves, masks = tree.filtered(c.astype(kind))
        rows, nearest = tree.resolved(c.astype(kind), leaves, masks)
        cluster = np.full(len(x), -1)
        for node, own in zip(whole, owner, strict=True):
            cluster[tree.start[node] : tree.end[node]] = own
        cluster[rows] = nearest
        want = np.argmin(((tree.x[:, None, :].astype(np.int64) - c) ** 2).sum(2), 1)
        assert cluster.tolist() == want.tolist()
        if dim < 3 and len(x) > 500:
            assert len(whole)  # nodes go whole where there is something to prune
        totals = kd_means._assigned(row, c.tolist(), 1)[2]
        assert [[int((want == j).sum()), *tree.x[want == j].sum(0).tolist()] for j in range(8)] == totals.tolist()


def rows_of(dim, rng):
    rows = [(i, [round(rng.gauss(i % 3, 0.4), 2) for _ in range(dim)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 180)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (None, [0.5] * dim), (-4, [-0.0] * dim)]
    return rows + [(200, None), (201, []), (202, [1.0] * (dim + 1)), (203, [None] + [1.0] * (dim - 1)), (204, [math.nan] * dim), (205, [math.inf] + [0.0] * (dim - 1))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(4)


def test_clusters_equal_brute_force(spark):
    rows = rows_of(5, random.Random(1))
    assert got(frame(spark, rows), dim=5, count=8, rounds=6) == brute(rows, 5, 8, 6)


def test_large_numbers_are_exact(spark):
    """Beyond 32 bits, beyond 64 bits and beyond what a double times the scale can hold."""
    rows = rows_of(3, random.Random(2)) + [(300, [1e6, -1e6, 0.0]), (301, [4e9, 1.0, 1.0]), (302, [1e30, -1e30, 1.5]), (303, [1.7e308, 0.0, 0.0]), (304, [-70000.0, 66000.5, 0.001])]
    assert got(frame(spark, rows), dim=3, count=6, rounds=3) == brute(rows, 3, 6, 3)


def test_few_and_no_vectors(spark):
    few = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    assert got(frame(spark, few), dim=2) == brute(few, 2, 8, 10)
    assert got(frame(spark, [(1, None), (2, [1.0])]), dim=2) == []
