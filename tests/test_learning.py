"""Exact samples, histogram trees and blocked learners against brute force and properties."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting, components, evaluate, learners, sampling

SMALL = {"rounds": 30, "leaves": 8, "seeds": (0, 1)}


def test_exact_sample_has_its_size_on_any_partitioning(spark):
    """Whole groups where there are fewer; one group of most rows; equal to the rows with the smallest hashes."""
    rows = [("a" if i % 10 else "b", i // 70, i % 70) for i in range(7000)] + [("c", -1, -1)]
    df = spark.createDataFrame(rows, "g string, r int, c int")
    one = {tuple(r) for r in sampling.exact_sample(df, "g", 900, ["r", "c"], 5).collect()}
    two = {tuple(r) for r in sampling.exact_sample(df.repartition(7), "g", 900, ["r", "c"], 5).collect()}
    assert one == two and Counter(g for g, *_ in one) == {"a": 900, "b": 700, "c": 1}
    hashed = df.withColumn("h", sampling.print_of(5, ["r", "c"])).collect()
    assert {tuple(r)[:3] for r in sorted((r for r in hashed if r.g == "a"), key=lambda r: r.h)[:900]} == {r for r in one if r[0] == "a"}
    assert one != {tuple(r) for r in sampling.exact_sample(df, "g", 900, ["r", "c"], 6).collect()}
    sizes = sampling.exact_sample(df, "g", F.when(F.col("g") == "a", 3).otherwise(0), ["r", "c"]).groupBy("g").count().collect()
    assert [tuple(r) for r in sizes] == [("a", 3)]


def test_exact_sample_ranks_equal_hashes_by_keys(spark, monkeypatch):
    monkeypatch.setattr(sampling, "print_of", lambda seed, keys: F.lit(7).cast("long"))
    df = spark.createDataFrame([("a", 0, i) for i in range(50)], "g string, r int, c int").repartition(5)
    assert sorted(r.c for r in sampling.exact_sample(df, "g", 12, ["r", "c"]).collect()) == list(range(12))


def test_fold_samples_are_exact_and_unseen_stays_unseen(spark):
    rows = [(i // 50, i % 50, i % 4, "p" if i % 7 == 0 else "n" if i % 7 < 6 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "r int, c int, own int, pool string")
    for part in (df, df.repartition(9)):
        got = sampling.fold_samples(part, F.array("own"), F.col("pool"), [0, 1, 2, 3], [3, 8], lambda n: {"p": 200, "n": n["n"] - 1})
        got = [(r.fold, r.seed, r.pool, r.r, r.c) for r in got.collect()]
        assert len(set(got)) == len(got)
        own = {(r, c): (o, p) for r, c, o, p in rows}
        assert all(own[r, c][0] != k and own[r, c][1] == p for k, _, p, r, c in got)
        seen = Counter((k, p) for k in range(4) for _, _, o, p in rows if o != k and p)
        assert Counter((k, s, p) for k, s, p, *_ in got) == {(k, s, p): 200 if p == "p" else seen[k, p] - 1 for k in range(4) for s in (3, 8) for p in "pn"}
        assert {x[3:] for x in got if x[:3] == (0, 3, "p")} != {x[3:] for x in got if x[:3] == (0, 8, "p")}
        first = set(got) if part is df else first
        assert set(got) == first
    whole = sampling.fold_samples(df, F.array("own"), F.col("pool"), [0, 1], [3], lambda n: {"p": 10**6})
    assert Counter((r.fold, r.pool) for r in whole.collect()) == {(k, "p"): seen[k, "p"] for k in (0, 1)}
    assert sampling.fold_samples(df, F.array("own"), F.col("pool"), [0], [3], lambda n: {}).count() == 0


def grow_slowly(x, y, rounds, rate, leaves, l2, least):
    """The same recipe, node by node over plain rows."""
    cuts = [boosting.edges(x[:, f]) for f in range(x.shape[1])]
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)  # noqa: B023, E731
        nodes = [np.arange(len(y))]
        while len(nodes) < leaves:
            best = (1e-12, None)
            for k, s in enumerate(nodes):
                for f in range(x.shape[1]):
                    for cut in cuts[f]:
                        a, b = s[x[s, f] <= cut], s[x[s, f] > cut]
                        if min(len(a), len(b)) >= least and min(h[a].sum(), h[b].sum()) > 1e-3:
                            gain = worth(a) + worth(b) - worth(s)
                            if gain > best[0] + 1e-12:
                                best = (gain, (k, a, b))
            if best[1] is None:
                break
            k, a, b = best[1]
            nodes[k : k + 1] = [a, b]
        for s in nodes:
            raw[s] -= rate * g[s].sum() / (h[s].sum() + l2)
    return 1 / (1 + np.exp(-raw))


def test_trees_equal_a_plain_version():
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(150, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + g.normal(size=150) * 0.3 > 0).astype(float)
    how = {"rounds": 6, "rate": 0.3, "leaves": 6, "l2": 1.0, "least": 5}
    model = boosting.Forest(boosting.fit_trees(x, y, **how))
    assert np.allclose(model.chance(x), grow_slowly(x, y, **how), atol=1e-9)


def test_trees_learn_and_lose_less_each_round():
    g = np.random.default_rng(2)
    x = g.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit_trees(x[:3000], y[:3000], rounds=101)
    assert all(b < a for a, b in zip(model["loss"], model["loss"][1:], strict=False))
    assert np.mean((boosting.Forest(model).chance(x[3000:]) > 0.5) == y[3000:]) > 0.97
    assert len(np.unique(np.diff([*model["first"], len(model["feature"])]))) and max(np.diff([*model["first"], len(model["feature"])])) <= 61
    for only in (0.0, 1.0):
        assert set(boosting.Forest(boosting.fit_trees(x, np.full(len(x), only))).chance(x[:5])) == {only}


def test_scoring_in_chunks_and_edges(monkeypatch):
    g = np.random.default_rng(3)
    x = g.normal(size=(500, 2))
    model = boosting.Forest(boosting.fit_trees(x, (x[:, 0] > 0.2).astype(float), rounds=10))
    whole = model.chance(x)
    monkeypatch.setattr(boosting, "CHUNK", 64)
    assert np.array_equal(model.chance(x), whole)
    assert boosting.edges(np.array([1.0, 1.0, 3.0])).tolist() == [2.0] and len(boosting.edges(g.normal(size=5000))) == 255


def field(spark, seed=24):
    g = np.random.default_rng(seed)
    m = g.random((30, 40)) < 0.2
    v, w = m + g.normal(size=m.shape) * 0.1, g.normal(size=m.shape)
    rows = [(r, c, bool(m[r, c]), float(v[r, c]), float(w[r, c]) if (r + c) % 9 else None, int(c >= 20), True) for r in range(30) for c in range(40)]
    return spark.createDataFrame(rows, "r int, c int, m boolean, v double, w double, block int, foot boolean")


def test_out_of_fold_uses_nothing_of_the_fold(spark):
    """Each cell once; wrong labels inside of a fold change nothing of its own chances."""
    df = field(spark)
    right = {(x.r, x.c): x.prob for x in learners.out_of_fold(df, ["v", "w"], F.col("m"), "block", 2, **SMALL).collect()}
    assert len(right) == 1200
    turned = df.withColumn("m", F.when(F.col("block") == 0, ~F.col("m")).otherwise(F.col("m")))
    other = {(x.r, x.c): x.prob for x in learners.out_of_fold(turned, ["v", "w"], F.col("m"), "block", 2, **SMALL).collect()}
    assert all(right[r, c] == other[r, c] for r, c in right if c < 20) and any(right[r, c] != other[r, c] for r, c in right if c >= 20)
    labels = {(x.r, x.c): x.m for x in df.collect()}
    assert np.mean([right[k] for k in right if labels[k]]) > np.mean([right[k] for k in right if not labels[k]]) + 0.5
    one = learners.out_of_fold(df.withColumn("m", F.col("block") == 1), ["v"], F.col("m"), "block", 2, **SMALL).collect()
    assert {(x.fold, x.prob) for x in one} == {(0, 1.0), (1, 0.0)}


def test_locked_comparator_learns_outside_of_its_cells(spark):
    df = field(spark)
    labelled = components.components(df.filter("m"))
    locked = evaluate.locked_cells(df.select("r", "c", "foot"), F.col("foot"), 4, 1)
    hidden = evaluate.hidden_components(labelled, locked, 2)
    ordinals = sorted(x[0] for x in locked.select("ordinal").distinct().collect())
    pools = learners.fold_pools(df, labelled, locked, hidden, ordinals, 2).collect()
    comp, gone = {(x.r, x.c): x.comp for x in labelled.collect()}, {(x.ordinal, x.comp) for x in hidden.collect()}
    box = {k: (min(x.r for x in cells) - 2, max(x.r for x in cells) + 2, min(x.c for x in cells) - 2, max(x.c for x in cells) + 2) for k in ordinals for cells in [[x for x in locked.collect() if x.ordinal == k]]}
    assert len(pools) == 1200
    for x in pools:
        inside = {k for k, (a, b, c, d) in box.items() if a <= x.r <= b and c <= x.c <= d}
        assert set(x.unseen) == inside | {k for k in ordinals if (k, comp.get((x.r, x.c))) in gone}
        assert x.pool == ("positive" if (x.r, x.c) in comp else "negative")
    got = learners.locked_comparator(df, ["v", "w"], labelled, locked, hidden, ordinals, 2, **SMALL).collect()
    active = {(x.r, x.c, x.ordinal) for x in locked.collect() if x.active}
    assert {(x.r, x.c, x.ordinal) for x in got} == active and len(got) == len(active) and all(0 <= x.prob <= 1 for x in got)


@pytest.mark.parametrize("least", [5, 500])
def test_discriminant_scores_every_cell(spark, least):
    rows = learners.discriminant(field(spark), ["v", "w"], F.col("m"), "block", 2, least=least, **SMALL).collect()
    assert len({(x.r, x.c) for x in rows}) == 1200
    if least == 500:
        assert {x.prob for x in rows} == {0.0}
    else:
        auc = learners.block_auc(spark.createDataFrame([(x.block, x.label, x.prob) for x in rows], "block int, label int, prob double"), "block", 5).collect()
        assert len(auc) == 2 and all(x.auc > 0.95 for x in auc)
