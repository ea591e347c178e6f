"""Boosted trees on histograms: one fit per group of a table of samples, all groups at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, CHUNK = 256, 8192
MODEL = "base double, feature array<int>, threshold array<double>, left array<int>, value array<double>, first array<int>, depth array<int>, loss array<double>"


def edges(column: np.ndarray) -> np.ndarray:
    """Where a feature may be cut: between neighbouring values where it has few, else between equal shares of the rows."""
    distinct = np.unique(column)
    if len(distinct) <= BINS:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="midpoint"))


def _split(hist: np.ndarray, l2: float, least: int) -> tuple[float, int, int]:
    """Gain, feature and last bin of the left side of the best cut of a node; a gain of 0 where there is none."""
    below = np.cumsum(hist, 2)[:, :, :-1]
    whole = hist[:, 0].sum(1)[:, None, None]
    above = whole - below
    gain = below[0] ** 2 / (below[1] + l2) + above[0] ** 2 / (above[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
    fits = (below[2] >= least) & (above[2] >= least) & (below[1] > 1e-3) & (above[1] > 1e-3)
    gain = np.where(fits, gain, 0.0)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.08, leaves: int = 31, l2: float = 1.0, least: int = 20) -> dict[str, Any]:
    """Boosted trees for the log loss: leaf-wise growth by gain, histograms of the smaller child, the sibling's by subtraction, Newton leaves.

    x has a row per example. With one class in y the model is that class. loss
    is the mean log loss after rounds 1, 11, 21 and so on.
    """
    n, width = x.shape
    share = float(y.mean()) if n else 0.0
    out: dict[str, Any] = {"base": 0.0, "feature": [], "threshold": [], "left": [], "value": [], "first": [], "depth": [], "loss": []}
    if share in (0.0, 1.0):
        return out | {"base": float("inf") if share else float("-inf")}
    out["base"] = float(np.log(share / (1 - share)))
    cuts = [edges(x[:, f]) for f in range(width)]
    codes = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]  # x <= cuts[b] exactly where the code is at most b
    raw = np.full(n, out["base"])
    every = np.arange(n)

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        hist, whole = np.empty((3, width, BINS)), len(rows) == n
        gr, hr = (g, h) if whole else (g[rows], h[rows])
        for f, code in enumerate(codes):
            code = code if whole else code[rows]
            hist[0, f], hist[1, f], hist[2, f] = np.bincount(code, gr, BINS), np.bincount(code, hr, BINS), np.bincount(code, minlength=BINS)
        return hist

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        base = len(out["feature"])
        feature, threshold, left, value, level = [0], [float("inf")], [0], [0.0], [0]  # a leaf leads to itself

        def leaf(node: int, rows: np.ndarray) -> None:
            value[node] = float(-rate * g[rows].sum() / (h[rows].sum() + l2))  # noqa: B023
            raw[rows] += value[node]  # noqa: B023

        hist = histogram(every, g, h)
        gain, f, b = _split(hist, l2, least)
        heap, done, grown = [(-gain, 0, f, b, every, hist)], [], 1
        while heap and grown < leaves:
            gain, node, f, b, rows, hist = heapq.heappop(heap)
            if gain == 0:
                done.append((node, rows))
                continue
            goes = codes[f][rows] <= b
            sides = rows[goes], rows[~goes]
            feature[node], threshold[node], left[node] = f, float(cuts[f][b]), len(feature)
            grown += 1
            small = len(sides[1]) < len(sides[0])
            some = histogram(sides[small], g, h) if grown < leaves else None
            for k in (0, 1):
                child = len(feature)
                feature.append(0), threshold.append(float("inf")), left.append(child), value.append(0.0), level.append(level[node] + 1)
                if some is None:
                    done.append((child, sides[k]))
                else:
                    mine = some if k == small else hist - some
                    gain_, f_, b_ = _split(mine, l2, least)
                    heapq.heappush(heap, (-gain_, child, f_, b_, sides[k], mine))
        for node, rows in [*done, *((e[1], e[4]) for e in heap)]:
            leaf(node, rows)
        out["first"].append(base)
        out["depth"].append(max(level))
        if (len(out["first"]) - 1) % 10 == 0:
            out["loss"].append(float(np.mean(np.logaddexp(0, raw) - y * raw)))
        for name, part in (("feature", feature), ("threshold", threshold), ("left", [base + k for k in left]), ("value", value)):
            out[name] += part
    return out


class Forest:
    """A fitted model, ready to score."""

    def __init__(self, row: Any):
        self.base = row["base"]
        self.feature, self.left, self.first, self.depth = (np.array(row[c], np.int64) for c in ("feature", "left", "first", "depth"))
        self.threshold, self.value = np.array(row["threshold"], float), np.array(row["value"], float)

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row of x."""
        if len(x) > CHUNK:  # what is gathered from stays in the cache
            return np.concatenate([self.chance(x[a : a + CHUNK]) for a in range(0, len(x), CHUNK)])
        raw, flat, begin = np.full(len(x), self.base), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for first, depth in zip(self.first.tolist(), self.depth.tolist(), strict=True):
            node = np.full(len(x), first)
            for _ in range(depth):
                node = self.left[node] + (flat[begin + self.feature[node]] > self.threshold[node])
            raw += self.value[node]
        return np.where(raw >= 0, 1 / (1 + np.exp(-np.abs(raw))), np.exp(-np.abs(raw)) / (1 + np.exp(-np.abs(raw))))


def fit(samples: DataFrame, by: dict[str, list[int]], features: list[str], label: str = "label", **how: Any) -> DataFrame:
    """A model for each group (columns of MODEL): each is fitted in a task of its own, on the sample of the group.

    by: the columns that tell groups apart, with their values.

    samples come from an operator that bounds a group's rows by its
    parameters (sampling.fold_samples). Rows are ordered before the fit, so a
    repeated task gives the same model. Null features count as 0.
    """
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    number, total = F.lit(0), 1
    for c, values in by.items():
        number = number * len(values) + F.array_position(F.lit(values), F.col(c)).cast("int") - 1
        total *= len(values)
    names = [f"f{k}" for k in range(len(features))]
    slim = samples.select(number.alias("task"), *by, F.col(label).cast("double").alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names, strict=True)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*names, "y"], kind="stable")
        model = fit_trees(group[names].to_numpy(float), group["y"].to_numpy(float), **how)
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, **model}])

    return slim.repartitionById(total, F.col("task")).groupBy("task", *by).applyInPandas(run, f"{kinds}, {MODEL}")


def score(cells: DataFrame, keep: list[str], features: list[str], fold: Column, models: list[Any], name: str = "prob", tasks: int | None = None) -> DataFrame:
    """keep and the chance of each row: the mean over the models (collected rows of fit, with fold) of its fold; 0 where a fold has none.

    What is sent to the tasks are the models: their size follows the rounds,
    leaves, folds and seeds, not the data. tasks deals few rows to so many
    tasks first, as scoring takes far longer than reading.
    """
    forests: dict[int, list[Forest]] = {}
    for m in models:
        forests.setdefault(m["fold"], []).append(Forest(m))
    sent = cells.sparkSession.sparkContext.broadcast(forests)
    width = len(features)
    slim = cells.select(*keep, fold.cast("int").alias("__fold"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{k}") for k, c in enumerate(features)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(len(keep) + 1 + k).to_numpy(zero_copy_only=False) for k in range(width)], 1)
            p = np.zeros(len(of))
            for k in np.unique(of[~pd.isna(of)]).tolist():
                mine, some = np.flatnonzero(of == k), sent.value.get(int(k), [])
                if some:
                    p[mine] = np.mean([f.chance(x[mine]) for f in some], 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(p)], names=[*keep, name])

    return (slim.repartition(tasks, *keep) if tasks else slim).mapInArrow(run, f"{schema}, {name} double")
