"""Sequential tests, budgets and prices, correlations and ranks: what decides between candidates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ALPHA, BETA
from ..session import settle
from .ordered import numbered, ordered, running


def bounds(alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> tuple[float, float]:
    """(upper, lower) log-likelihood ratios at which a test stops."""
    if not (0 < alpha < 1 and 0 < beta < 1):
        raise ValueError("alpha and beta must lie between 0 and 1")
    if boundary == "ville":
        return math.log(1 / alpha), math.log(beta)
    if boundary == "wald":
        return math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    raise ValueError(f"no boundary {boundary}")


def steps(p0: float, p1: float) -> tuple[float, float]:
    """What a win and a loss add."""
    if not 0 < p0 < p1 < 1:
        raise ValueError("0 < p0 < p1 < 1 must hold")
    return math.log(p1 / p0), math.log((1 - p1) / (1 - p0))


def folds_needed(p0: float = 0.5, p1: float = 0.7, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> tuple[int, int]:
    """Wins in a row that accept, losses in a row that reject."""
    up, low = bounds(alpha, beta, boundary)
    win, loss = steps(p0, p1)
    return math.ceil(up / win - 1e-12), math.ceil(low / loss - 1e-12)


def bounds_of(alpha: Column, beta: Column, boundary: str = "ville") -> tuple[Column, Column]:
    """bounds for columns of error rates; null where one does not lie between 0 and 1."""
    sane = (alpha > 0) & (alpha < 1) & (beta > 0) & (beta < 1)
    up, low = (1 / alpha, beta) if boundary == "ville" else ((1 - beta) / alpha, beta / (1 - alpha))
    return F.when(sane, F.ln(up)), F.when(sane, F.ln(low))


def folds_of(p0: Column, p1: Column, alpha: Column, beta: Column, boundary: str = "ville") -> tuple[Column, Column]:
    """folds_needed for columns of parameters: wins in a row that accept, losses in a row that reject."""
    up, low = bounds_of(alpha, beta, boundary)
    sane = (p0 > 0) & (p0 < p1) & (p1 < 1)
    return F.when(sane, F.ceil(up / F.ln(p1 / p0) - 1e-12)), F.when(sane, F.ceil(low / F.ln((1 - p1) / (1 - p0)) - 1e-12))


def maximin(budgets: DataFrame, plan: str, n: str, truths: DataFrame, k: str, rate: float, hit: float, fade: float) -> DataFrame:
    """(plan, n, worst, best): each budget's worst score over the truth sizes, and whether it is the best of all (ties: the smallest plan).

    A budget of n points hits with hit * (2000 / n) ** fade each, of which the
    truth k saturates. Both tables hold a row per parameter, and the smaller
    one is what each budget is scored against.
    """
    both = budgets.crossJoin(F.broadcast(truths.select(F.col(k).alias("__k"))))  # parameters, not data
    w = F.lit(hit) * F.pow(F.lit(2000.0) / F.col(n), F.lit(fade))
    tp = F.col("__k") * (1 - F.exp(-rate * F.col(n) * w / F.col("__k")))
    scored = both.withColumn("__s", tp / (ALPHA * tp + ALPHA * F.col(n) + BETA * F.col("__k")))
    worst = scored.groupBy(plan, n).agg(F.min("__s").alias("worst"))
    first = worst.agg(F.min(F.struct(-F.round("worst", 9), F.col(plan).alias("p"))).alias("f")).select(F.col("f.p").alias("__best"))
    return worst.crossJoin(F.broadcast(first)).select(plan, n, "worst", (F.col(plan) == F.col("__best")).alias("best"))


def other_boundary(decided: DataFrame, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> DataFrame:
    """decided (rows of a sequential test) with other: the decision that the other boundary's bounds give at the ratio where the test stopped."""
    up, low = bounds(alpha, beta, "wald" if boundary == "ville" else "ville")
    return decided.withColumn("other", F.when(F.col("llr") >= up, "accept_H1").when(F.col("llr") <= low, "accept_H0").otherwise("continue"))


def _first_crossing(df: DataFrame, llr: Column, by: str, order: str, up: float, low: float) -> DataFrame:
    run = df.withColumn("llr", llr)
    crossed = F.when((F.col("llr") >= up) | (F.col("llr") <= low), F.struct(F.col(order).alias("k"), F.col("llr")))
    ends = run.groupBy(by).agg(F.min(crossed).alias("stop"), F.max(F.struct(F.col(order).alias("k"), F.col("llr"))).alias("last"), F.count(F.lit(1)).alias("total"))
    at = F.coalesce("stop", "last")
    decision = F.when(at["llr"] >= up, "accept_H1").when(at["llr"] <= low, "accept_H0").otherwise("continue")
    return ends.select(by, "total", at["k"].cast("long").alias("stopped_at"), at["llr"].alias("llr"), decision.alias("decision"))


def sprt_sign(outcomes: DataFrame, by: str = "candidate", order: str = "k", win: str = "win", p0: float = 0.5, p1: float = 0.7, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> DataFrame:
    """Per candidate: outcomes in all, where the test stopped, its ratio there, and the decision; what comes later doesn't count."""
    up, low = bounds(alpha, beta, boundary)
    w, l = steps(p0, p1)
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # outcomes of one candidate: tens
    wins, n = F.sum(F.col(win).cast("int")).over(so_far), F.count(F.lit(1)).over(so_far)
    return _first_crossing(outcomes, wins * F.lit(w) + (n - wins) * F.lit(l), by, order, up, low)


def sprt_mean(samples: DataFrame, by: str = "candidate", order: str = "k", value: str = "delta", d: float = 0.5, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> DataFrame:
    """The same for means: the ratio is d / s * sum(x) - n * d * d / 2 with s the deviation of all samples (or their |mean|, or 1)."""
    up, low = bounds(alpha, beta, boundary)
    every = Window.partitionBy(by)
    so_far = every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = F.stddev_samp(value).over(every)
    s = F.when(s > 1e-12, s).when(F.abs(F.avg(value).over(every)) > 1e-12, F.abs(F.avg(value).over(every))).otherwise(1.0)
    llr = F.lit(d) / s * F.sum(value).over(so_far) - F.count(F.lit(1)).over(so_far) * (d * d / 2)
    return _first_crossing(samples, llr, by, order, up, low)


# -- budgets ----------------------------------------------------------------


def rolling_rate(hits: DataFrame, half: int = 750, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of hit over the ranks [rank - half, rank + half], cut off at the ends.

    Chunks of ranks, each with its neighbours' rims, so a curve is not one task.
    """
    size = max(4 * half, 1)
    dealt = hits.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("rank") - half) / size), F.floor((F.col("rank") + half) / size))))
    w = Window.partitionBy(*by, "chunk").orderBy("rank").rangeBetween(-half, half)
    return dealt.withColumn("rate", F.avg(F.col("hit").cast("double")).over(w)).filter(F.col("chunk") == F.floor(F.col("rank") / size)).drop("chunk")


def prefix_rate(hits: DataFrame, size: int = 65_536) -> DataFrame:
    """cum, the hits up to each rank: sums of chunks first, then running sums within chunks."""
    chunk = F.floor(F.col("rank") / size)
    dealt = hits.withColumn("chunk", chunk)
    totals = dealt.groupBy("chunk").agg(F.sum(F.col("hit").cast("long")).alias("n"))
    before = totals.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))  # a row per chunk
    own = F.sum(F.col("hit").cast("long")).over(Window.partitionBy("chunk").orderBy("rank"))
    return dealt.join(before, "chunk").withColumn("cum", F.col("before") + own).drop("chunk", "before")


def forward(n: Column, m: Column, g: float, l0: float = 3.0, kb: float = 0.5) -> Column:
    """Score of n dots with m hits against g truth cells: TP = g (1 - exp(-l0 m / g)), FP = n - kb m."""
    tp = g * (1 - F.exp(-l0 * m / g))
    fp = n - kb * m
    return tp / (ALPHA * tp + ALPHA * fp + BETA * g)


def saturating(n: Column, w: Column, k: float, a: float) -> Column:
    """Score of n dots of mean credit w: TP = k (1 - exp(-a n w / k))."""
    tp = k * (1 - F.exp(-a * n * w / k))
    return tp / (ALPHA * tp + ALPHA * n + BETA * k)


def break_even(score: Column, hits: Column, g: float, l0: float = 3.0, kb: float = 0.5) -> Column:
    """The hit rate at which one more dot leaves the score as it is."""
    slope = l0 * F.exp(-l0 * hits / g)
    return ALPHA * score / (slope * (1 - ALPHA * score) + ALPHA * score * kb)


def implied_hits(n: float, score: float, g: float, l0: float = 3.0, kb: float = 0.5) -> float:
    """The hit rate at which the forward model gives score, by bisection; not a number where it gives it nowhere."""
    def f(h: float) -> float:
        m = h * n
        tp = g * (1 - math.exp(-l0 * m / g))
        return tp / (ALPHA * tp + ALPHA * (n - kb * m) + BETA * g) - score

    lo, hi = 0.0, 1.0
    if f(lo) * f(hi) > 0:
        return math.nan
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(lo) * f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def fit_saturating(n: np.ndarray, w: np.ndarray, score: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """(k, a, root mean square error) by a grid in logarithms that closes in on the best; tens of rows, on the driver."""
    n, w, score = (np.asarray(x, float) for x in (n, w, score))

    def error(k: np.ndarray, a: np.ndarray) -> np.ndarray:
        k, a = k[..., None], a[..., None]
        tp = k * (1 - np.exp(-a * n * w / k))
        return np.sqrt(((tp / (ALPHA * tp + ALPHA * n + BETA * k) - score) ** 2).mean(-1))

    at, step = np.array([np.log(6000.0), 0.0]), np.array([2.5, 2.0])
    for _ in range(rounds):
        grid = np.stack(np.meshgrid(*(np.linspace(-1, 1, 9),) * 2, indexing="ij"), -1).reshape(-1, 2) * step + at
        e = error(np.exp(grid[:, 0]), np.exp(grid[:, 1]))
        at, step = grid[e.argmin()], step * 0.8
    k, a = np.exp(at)
    return float(k), float(a), float(error(np.array([k]), np.array([a]))[0])


# -- correlations and ranks --------------------------------------------------


def average_ranks(df: DataFrame, x: str, out: str, weight: str | None = None) -> DataFrame:
    """(x, out): the rank from 1 of each distinct value, equal values sharing the mean of theirs; sorted by ranges, however often a value stands. weight: a row stands for so many."""
    times = F.sum(weight) if weight else F.count(F.lit(1))
    per = running(ordered(df.groupBy(x).agg(times.alias("__n")), x), F.col("__n"), "__below", "__all")
    return per.select(x, (F.col("__below") + (F.col("__n") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho and n over rows without nulls: ranks are joined to the counts of pairs of values."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    pairs = settle(pairs, "value_pairs")
    both = pairs.join(average_ranks(pairs, x, "a", "w"), x).join(average_ranks(pairs, y, "b", "w"), y)
    sums = both.agg(*(F.sum(F.col("w") * e).alias(n) for n, e in (("n", F.lit(1)), ("sa", F.col("a")), ("sb", F.col("b")))))
    centred = both.crossJoin(F.broadcast(sums)).withColumns({"a": F.col("a") - F.col("sa") / F.col("n"), "b": F.col("b") - F.col("sb") / F.col("n")})  # one row
    total = lambda e: F.sum(F.col("w") * e)
    return centred.agg((total(F.col("a") * F.col("b")) / F.sqrt(total(F.col("a") * F.col("a")) * total(F.col("b") * F.col("b")))).alias("rho"), F.coalesce(F.sum("w"), F.lit(0)).alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, tie: str) -> DataFrame:
    """Correlation of the ranks of x and y less what the ranks of z explain; ties go by tie. Each rank is a sort by ranges."""
    def rank(t: DataFrame, v: str, out: str) -> DataFrame:
        return numbered(ordered(t, v, "__t"), out)

    r = df.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(z).alias("__z"), F.col(tie).alias("__t"))
    for v in "xyz":
        r = rank(r, f"__{v}", v)
    r = settle(r.select("x", "y", "z", "__t"), "ranks")
    fit = r.agg(*(f(F.col(v), F.col("z")).alias(f"{n}{v}") for v in "xy" for n, f in (("s", F.regr_slope), ("i", F.regr_intercept))))
    left = r.crossJoin(F.broadcast(fit)).select("__t", *((F.round(F.col(v) - F.col(f"i{v}") - F.col(f"s{v}") * F.col("z"), 9)).alias(v) for v in "xy"))  # one row
    both = rank(rank(left, "x", "a"), "y", "b")
    return both.agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve by counts per distinct score: positives above negatives, ties half; partial sums, then running ones."""
    per = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.when(F.col(positive), 1)).alias("p"), F.count(F.when(~F.col(positive), 1)).alias("n"))
    per = running(ordered(per, score), F.col("n"), "below", "all")
    wins = per.select((F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"), "p", "n")
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def rank_lift(df: DataFrame, field: str, truth: str) -> DataFrame:
    """Mean over truth cells of the mid-rank of their value among all cells, as 0 to 1."""
    per = df.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth), 1)).alias("t"))
    per = running(ordered(per, field), F.col("n"), "below", "all")
    mid = per.select(((2 * F.col("below") + F.col("n")) / 2 / F.col("all")).alias("mid"), "t")
    return mid.agg((F.sum(F.col("mid") * F.col("t")) / F.sum("t")).alias("lift"), F.sum("t").alias("truths"))


def lift_by(df: DataFrame, field: str, truth: str, by: str) -> DataFrame:
    """rank_lift of each of several fields in a long table (by, value, truth)."""
    per = df.groupBy(by, field).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth), 1)).alias("t"))
    per = running(ordered(per, by, field), F.col("n"), "below", "all")
    first = per.groupBy(by).agg(F.min("below").alias("first"), F.sum("n").alias("cells"), F.sum("t").alias("truths"))
    mid = (2 * (F.col("below") - F.col("first")) + F.col("n")) / 2 / F.col("cells")
    return per.join(first, by).groupBy(by).agg((F.sum(mid * F.col("t")) / F.first("truths")).alias("lift"), F.first("truths").alias("truths"))


def promote(candidates: DataFrame, gate: Column, score: str, name: str) -> DataFrame:
    """The best candidate that passes the gate, else the best of all; equal scores by name."""
    passed = candidates.withColumn("passed", F.coalesce(gate, F.lit(False)))
    return passed.orderBy(F.desc("passed"), F.desc(score), name).limit(1)


def left_rank_lift(df: DataFrame, field: str, truth: str, by: str) -> DataFrame:
    """Per fold: mean over truth cells of the share of its cells with a smaller value, ties not counted; 0.5 without truth."""
    per = df.groupBy(by, field).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(truth), 1)).alias("t"))
    per = running(ordered(per, by, field), F.col("n"), "below", "all")
    folds = per.groupBy(by).agg(F.min("below").alias("first"), F.sum("n").alias("cells"), F.sum("t").alias("truths"))
    lift = F.sum(F.col("t") * (F.col("below") - F.col("first")) / F.col("cells")) / F.first("truths")
    return per.join(folds, by).groupBy(by).agg(F.first("cells").alias("cells"), F.first("truths").alias("truths"), F.coalesce(F.when(F.first("truths") > 0, lift), F.lit(0.5)).alias("lift"))


def ties_at_top(df: DataFrame, bands: list[str], where: Column, high: float = 0.995) -> DataFrame:
    """Per band: its most, how many cells of the domain have just that, and how many reach its high quantile."""
    from .normalise import quantile_row

    inside = df.filter(where)
    q = quantile_row(inside, {f"q_{b}": (b, high) for b in bands}).crossJoin(inside.agg(*(F.max(b).alias(f"m_{b}") for b in bands)))
    counts = inside.crossJoin(F.broadcast(q)).agg(*(f for b in bands for f in (F.max(f"m_{b}").cast("double").alias(f"most_{b}"), F.count(F.when(F.col(b) >= F.col(f"m_{b}"), 1)).alias(f"top_{b}"), F.count(F.when(F.col(b) >= F.col(f"q_{b}"), 1)).alias(f"high_{b}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"most_{b}").alias("most"), F.col(f"top_{b}").alias("at_most"), F.col(f"high_{b}").alias("at_high")) for b in bands)))
    return counts.select(rows.alias("x")).select("x.*")
