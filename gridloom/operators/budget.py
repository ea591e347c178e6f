"""How many points to emit: prices of a further point, crossings of a curve, and truth sizes behind two scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ALPHA, BETA
from ..session import settle
from .decision import break_even, fit_saturating, forward, prefix_rate, rolling_rate
from .metric import parts


def score_of(n: np.ndarray, m: np.ndarray, g: np.ndarray, l0: np.ndarray, kb: np.ndarray) -> np.ndarray:
    """The forward model on arrays: n points, m hits, g truth cells."""
    tp = g * (1 - np.exp(-l0 * m / g))
    return tp / (ALPHA * tp + ALPHA * (n - kb * m) + BETA * g)


def hits_for(n: np.ndarray, score: np.ndarray, g: np.ndarray, l0: np.ndarray, kb: np.ndarray, rounds: int = 80) -> np.ndarray:
    """The hits that give a score, by bisection over 0 to n (the score rises with them); not a number where none do."""
    lo, hi = np.zeros(np.broadcast(n, score, g).shape), np.broadcast_to(n, np.broadcast(n, score, g).shape).astype(float)
    fits = score_of(n, hi, g, l0, kb) >= score
    for _ in range(rounds):
        mid = (lo + hi) / 2
        low = score_of(n, mid, g, l0, kb) < score
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(fits, (lo + hi) / 2, np.nan)


def implied_rates(df: DataFrame, n: str, score: str, g: str, out: str = "rate", l0: float = 3.0, kb: float = 0.5) -> DataFrame:
    """out: the hit rate at which n points have that score against g truth cells; null where no rate does."""
    @F.pandas_udf("double")
    def rate(n_: pd.Series, s: pd.Series, g_: pd.Series) -> pd.Series:
        m = hits_for(n_.to_numpy(float), s.to_numpy(float), g_.to_numpy(float), l0, kb)
        return pd.Series(m / n_.to_numpy(float)).where(lambda x: x.notna(), None)

    return df.withColumn(out, rate(F.col(n).cast("double"), F.col(score).cast("double"), F.col(g).cast("double")))


def solve_pairs(df: DataFrame, least: float = 100.0, most: float = 5e6) -> DataFrame:
    """Truth size g and hits m behind the scores of a set of points and of the same set pruned.

    df: n_base, s_base, n_prune, s_prune, removed (hits among the removed
    points), l0, kb; a row per pair and assumption. For every size the hits
    follow from the base score; the size is where the pruned score agrees too.
    Adds g, m, rate and residual; null where no size does.
    """
    names = ["n_base", "s_base", "n_prune", "s_prune", "removed", "l0", "kb"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, s, n2, s2, gone, l0, kb = (b[x].to_numpy(float)[:, None] for x in names)

            def miss(g: np.ndarray) -> np.ndarray:
                m = hits_for(n, s, g, l0, kb)
                return score_of(n2, np.maximum(m - gone, 1e-9), g, l0, kb) - s2

            sizes = np.geomspace(least, most, 400)[None, :]
            at = miss(sizes)
            turn = np.isfinite(at[:, 1:]) & np.isfinite(at[:, :-1]) & (at[:, 1:] * at[:, :-1] <= 0)
            k = turn.argmax(1)
            lo, hi, sign = sizes[0, k][:, None], sizes[0, k + 1][:, None], np.sign(at[np.arange(len(b)), k])[:, None]
            for _ in range(80):
                mid = np.sqrt(lo * hi)
                same = np.sign(miss(mid)) == sign
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
            g = np.sqrt(lo * hi)
            m, rest, found = hits_for(n, s, g, l0, kb), np.abs(miss(g)), turn.any(1)
            for name, v in (("g", g), ("m", m), ("rate", m / n), ("residual", rest)):
                b[name] = np.where(found, v[:, 0], np.nan)
            yield b

    columns = df.columns
    schema = df.schema
    for name in ("g", "m", "rate", "residual"):
        schema = type(schema)(list(schema.fields)).add(name, "double")
    solved = df.mapInPandas(solve, schema)
    return solved.select(*columns, *(F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in ("g", "m", "rate", "residual")))


def pair_sensitivity(pairs: DataFrame, l0: list[float], kb: list[float]) -> DataFrame:
    """Per pair: least, median and most truth size, and the range of hit rates, over all assumptions; a row per pair and assumption is solved on its own."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in l0 for b in kb], "l0 double, kb double")  # parameters, not data
    solved = solve_pairs(pairs.drop("l0", "kb").crossJoin(grid))
    keys = [c for c in pairs.columns if c not in ("l0", "kb")]
    return solved.groupBy(*keys).agg(F.count("g").alias("solved"), F.min("g").alias("g_least"), F.expr("percentile(g, 0.5)").alias("g_median"), F.max("g").alias("g_most"), F.min("rate").alias("rate_least"), F.max("rate").alias("rate_most"))


def first_crossing(hits: DataFrame, price: float | Column, least: int, half: int = 750, transfer: float = 1.0) -> DataFrame:
    """One row: cut, the first rank from least on (counted from 0) at which the rate around it falls below price, or the number of points; and the mean rate up to it."""
    curve = prefix_rate(rolling_rate(hits, half).select("rank", "hit", (F.col("rate") / transfer).alias("rate")))
    price = price if isinstance(price, Column) else F.lit(price)
    cut = F.coalesce(F.min(F.when((F.col("rank") > least) & (F.col("rate") < price), F.col("rank") - 1)), F.max("rank"))
    found = curve.agg(cut.cast("long").alias("cut"))
    total = F.coalesce(F.sum(F.when(F.col("rank") <= F.col("cut"), F.col("hit").cast("int"))), F.lit(0))
    return curve.crossJoin(F.broadcast(found)).groupBy("cut").agg((total / F.greatest(F.first("cut"), F.lit(1))).alias("mean_rate"))  # one row


def priced_budget(hits: DataFrame, g: float, start: float = 0.2778, half: int = 750, least: int = 1000, transfer: float = 1.0, l0: float = 3.0, kb: float = 0.5, rounds: int = 12, near: int = 50) -> DataFrame:
    """The budget at which its own score sets the price: a row per round with score_in, price, n and score_out.

    A round prices a further point at the present score, and takes as many
    points as have a rate around them above that price. It ends when n moves
    by near or less. Each round reads one number from the curve, which stays
    a table.
    """
    curve = settle(prefix_rate(rolling_rate(hits, half).select("rank", "hit", (F.col("rate") / transfer).alias("rate"))).select("rank", "rate", "cum"), "curve")
    spark, path, n, score, hits_now = hits.sparkSession, [], None, start, 0.0
    for k in range(rounds):
        price = break_even(F.lit(score), F.lit(hits_now), g, l0, kb)
        cut = F.coalesce(F.min(F.when((F.col("rank") > least) & (F.col("rate") < price), F.col("rank") - 1)), F.max("rank"))
        one = curve.agg(cut.alias("n"), F.first(price).alias("price"))
        row = curve.crossJoin(F.broadcast(one)).filter(F.col("rank") == F.col("n")).select("n", "price", (F.col("cum") / transfer).alias("m"), forward(F.col("n"), F.col("cum") / transfer, g, l0, kb).alias("score")).first()
        if row is None:
            break
        path.append((k, float(score), float(row["price"]), int(row["n"]), float(row["score"])))
        settled = n is not None and abs(row["n"] - n) <= near
        n, score, hits_now = row["n"], row["score"], row["m"]
        if settled:
            break
    return spark.createDataFrame(path, "round int, score_in double, price double, n long, score_out double")


def marginal_credit(dots: DataFrame, cells: DataFrame, truth: str, by: str, budgets: list[int]) -> DataFrame:
    """Per budget: points, pooled TP, FP, FN over the folds, their index, and the credit of a point.

    dots: (r, c, rank), best first; a budget is the prefix of that many. cells:
    (r, c, by, truth), all that counts. All budgets are measured in one pass.
    """
    spark = dots.sparkSession
    grid = F.broadcast(spark.createDataFrame([(n,) for n in budgets], "budget long"))  # parameters, not data
    taken = dots.crossJoin(grid).filter(F.col("rank") <= F.col("budget"))
    marked = cells.crossJoin(grid).join(taken.select("r", "c", "budget", F.lit(1.0).alias("__p")), ["r", "c", "budget"], "left").fillna(0.0, ["__p"])
    folds = parts(marked, "__p", truth, by=("budget", by))
    n = taken.groupBy("budget").agg(F.count(F.lit(1)).alias("dots"))
    total = folds.groupBy("budget").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    return total.join(n, "budget").select("budget", "dots", "tp", "fp", "fn", (F.col("tp") / (F.col("tp") + ALPHA * F.col("fp") + BETA * F.col("fn") + 1e-12)).alias("dti"), (F.col("tp") / F.greatest("dots", F.lit(1))).alias("credit"))


def leave_one_out(artifacts: DataFrame, key: str, n: str = "n", w: str = "w", score: str = "score") -> DataFrame:
    """Per artifact: the saturating score fitted on all others, what it says of this one, and the error. Tens of artifacts; each is left out in a task of its own."""
    every = artifacts.select(F.col(n).alias("n"), F.col(w).alias("w"), F.col(score).alias("score"), F.col(key).alias("other"))
    pairs = artifacts.select(F.col(key).alias("left_out")).join(every)  # a table of artifacts with itself

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        one, rest = rows[rows.other == rows.left_out], rows[rows.other != rows.left_out]
        k, a, _ = fit_saturating(rest.n, rest.w, rest.score)
        tp = k * (1 - np.exp(-a * one.n.to_numpy() * one.w.to_numpy() / k))
        said = tp / (ALPHA * tp + ALPHA * one.n.to_numpy() + BETA * k)
        return pd.DataFrame({"key": one.other.to_numpy(), "k": k, "a": a, "predicted": said, "error": said - one.score.to_numpy()})

    return pairs.groupBy("left_out").applyInPandas(fit, f"key {artifacts.schema[key].dataType.simpleString()}, k double, a double, predicted double, error double")

