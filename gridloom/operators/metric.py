"""Distance-weighted Tversky index (DTI) and what is measured with it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import ALPHA, BETA, EPSILON, RADIUS, credit_offsets
from .distance import near
from .stencil import TILE, tiled


def dti(tp: str | Column, fp: str | Column, fn: str | Column) -> Column:
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    return tp / (tp + ALPHA * fp + BETA * fn + EPSILON)


def parts(cells: DataFrame, pred: str, truth: str, active: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, n_truth (and dti) of a prediction with weights 0 to 1, for each value of by.

    tp: over truth cells, the most of weight * credit that a predicted cell
    within three cells gives; fp: over predicted cells, weight times what
    credit the nearest truth cell leaves; fn: truth cells less tp. active
    cells count on both sides; cells see each other across folds only where
    by is empty. Without truth dti is 0 and fp the sum of weights. Marked and
    predicted cells go to tiles with a frame of three cells, once; a tile
    gives its sums.
    """
    live = cells if active is None else cells.filter(active)
    slim = live.select(*by, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.when(F.col(pred) > 0, F.col(pred).cast("double")).otherwise(0.0).alias("__p"), F.coalesce(F.col(truth), F.lit(False)).alias("__t"))
    moves, frame = credit_offsets(), math.ceil(RADIUS)
    kinds = "".join(f"{x} {slim.schema[x].dataType.simpleString()}, " for x in by)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of a tile's own cells, from its cells and those of its frame."""
        tr, tc = int(rows.tr.iloc[0]), int(rows.tc.iloc[0])
        r, c, p, t = rows.r.to_numpy(np.int64), rows.c.to_numpy(np.int64), rows["__p"].to_numpy(float), rows["__t"].to_numpy(bool)
        mine = (r // TILE == tr) & (c // TILE == tc)
        y, x = r - tr * TILE + 2 * frame, c - tc * TILE + 2 * frame
        side = TILE + 4 * frame
        weight, marks = np.zeros((side, side)), np.zeros((side, side))
        np.maximum.at(weight, (y, x), p)
        marks[y[t], x[t]] = 1.0
        own_t, own_p = mine & t, mine & (p > 0)
        given, seen = np.zeros(int(own_t.sum())), np.zeros(int(own_p.sum()))
        for i, j, k in moves:
            given = np.maximum(given, k * weight[y[own_t] + i, x[own_t] + j])
            seen = np.maximum(seen, k * marks[y[own_p] + i, x[own_p] + j])
        return pd.DataFrame([{**{b: rows[b].iloc[0] for b in by}, "tp": given.sum(), "fp": (p[own_p] * (1 - seen)).sum(), "n_truth": len(given), "n_pred": len(seen)}])

    tiles = tiled(slim.filter("__p > 0 OR __t"), frame, TILE).groupBy(*by, "tr", "tc").applyInPandas(one, f"{kinds}tp double, fp double, n_truth long, n_pred long")
    totals = tiles.groupBy(*by).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast(k).alias(v) for v, k in (("tp", "double"), ("fp", "double"), ("n_truth", "long"), ("n_pred", "long"))))
    out = totals.filter("n_truth + n_pred > 0") if by else totals  # a frame alone makes no fold
    return out.withColumn("fn", F.col("n_truth") - F.col("tp")).withColumn("dti", F.when(F.col("n_truth") > 0, dti("tp", "fp", "fn")).otherwise(0.0))


def pooled(folds: DataFrame) -> DataFrame:
    total = folds.agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), F.count(F.lit(1)).alias("folds"))
    return total.withColumn("dti", dti("tp", "fp", "fn"))


def fold_delta(candidate: DataFrame, anchor: DataFrame, by: str, anchor_score: Column) -> DataFrame:
    """Per fold (tp_c - tp_a)(1 - 0.2 s) - 0.2 s (fp_c - fp_a): adds up over separate folds."""
    a = anchor.select(by, F.col("tp").alias("tp_a"), F.col("fp").alias("fp_a"))
    both = candidate.join(a, by)
    return both.withColumn("delta", (F.col("tp") - F.col("tp_a")) * (1 - ALPHA * anchor_score) - ALPHA * anchor_score * (F.col("fp") - F.col("fp_a")))


def hits(dots: DataFrame, truth: DataFrame, radius: float = RADIUS) -> DataFrame:
    """dots with hit: a truth cell lies within radius, the rim included."""
    around = near(truth, radius).select("r", "c", F.lit(True).alias("hit"))
    return dots.join(around, ["r", "c"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def credit(dots: DataFrame, truth: DataFrame, radius: float = RADIUS) -> DataFrame:
    """w, the mean credit of dots, and n."""
    around = near(truth, radius).select("r", "c", (1 - F.col("d") / radius).alias("k"))
    return dots.join(around, ["r", "c"], "left").agg(F.avg(F.coalesce("k", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n"))


def leakage(mask: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the mask's cells that are truth cells themselves."""
    both = mask.join(truth.select("r", "c", F.lit(1).alias("t")), ["r", "c"], "left")
    return both.agg(F.count("t").alias("shared"), F.count(F.lit(1)).alias("n")).withColumn("leakage", F.col("shared") / F.greatest(F.col("n"), F.lit(1)))
