"""Taps and offsets: small fixed tables that stencils and radius joins are made of."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the distance-weighted Tversky index: radius in cells, weights of false positives and negatives, and what keeps its denominator above zero.
RADIUS, ALPHA, BETA, EPSILON = 3.0, 0.2, 0.8, 1e-12


def gaussian_taps(sigma: float, order: int = 0, truncate: float = 4.0) -> dict[int, float]:
    """Weights by offset of a sampled Gaussian of radius int(truncate * sigma + 0.5), or of its first or second derivative."""
    radius = int(truncate * sigma + 0.5)
    raw = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    total = sum(raw.values())
    scale = {0: lambda x: 1.0, 1: lambda x: x / sigma**2, 2: lambda x: x * x / sigma**4 - 1 / sigma**2}[order]
    return {k: v / total * scale(k) for k, v in raw.items()}


def offsets(radius: float) -> list[tuple[int, int, float]]:
    """(dr, dc, distance) of all cells within radius."""
    n = int(math.floor(radius))
    return [(i, j, math.hypot(i, j)) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i, j) <= radius]


def credit_offsets(radius: float = RADIUS) -> list[tuple[int, int, float]]:
    """(dr, dc, k) with k = 1 - distance / radius above zero."""
    return [(i, j, 1 - d / radius) for i, j, d in offsets(radius) if d < radius]


def cross_offsets(steps: int) -> list[tuple[int, int]]:
    """Cells that so many steps over edges reach."""
    return [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps]


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table of a few rows, for a join that Spark broadcasts by its size."""
    return spark.createDataFrame(rows, schema)
