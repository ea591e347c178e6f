"""Smoothed features of single cells: only the cells that the points' stencils reach are read and weighed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_taps
from ..session import settle
from .stencil import tiled

#: Ranges of rows that a scan is asked for at most; nearer ones are merged, so that more is read and never less.
RANGES = 200


def _ranges(rows: list[int], side: int, radius: int) -> list[tuple[int, int]]:
    """Rows (first, last) that tiles in these bands and their frames hold, merged where they touch, and then where they are nearest."""
    out: list[list[int]] = []
    for t in sorted(rows):
        lo, hi = t * side - radius, (t + 1) * side - 1 + radius
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    while len(out) > RANGES:
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[k : k + 2] = [[out[k][0], out[k + 1][1]]]
    return [(a, b) for a, b in out]


def reached(cells: DataFrame, points: DataFrame, radius: int, tile: int = 64) -> DataFrame:
    """The cells that a stencil of radius can reach from a tile with points, with tr and tc of that tile.

    Bands of rows with points are told to the scan (they are as many as the
    lattice has bands of tiles, RANGES at most), so files and row groups
    outside are skipped; the tiles themselves then come by a join.
    """
    owners = settle(points.select(F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")).distinct(), "owner_tiles")
    bands = [r.tr for r in owners.select("tr").distinct().collect()]  # a row per band of tiles
    span = owners.agg(F.min("tc"), F.max("tc")).first()
    if not bands:
        return tiled(cells.limit(0), radius, tile)
    near = [F.col("r").between(a, b) for a, b in _ranges(bands, tile, radius)]
    inside = near[0]
    for n in near[1:]:
        inside = inside | n
    columns = F.col("c").between(span[0] * tile - radius, (span[1] + 1) * tile - 1 + radius)
    return tiled(cells.filter(inside & columns), radius, tile).join(owners, ["tr", "tc"], "left_semi")


def smoothed_at(cells: DataFrame, points: DataFrame, features: dict[str, tuple[str, float]], tile: int = 64) -> DataFrame:
    """(r, c, features) of each point that is a cell: feature -> (band, sigma); sigma 0 is the band itself.

    The values are those of stencil.smooth over all cells: edges of the
    lattice repeat, and a cell without a value gives null wherever a stencil
    reaches it. Work and bytes follow the tiles with points, not the lattice.
    Repeated points count once.
    """
    names = list(features)
    used = sorted({b for b, _ in features.values()})
    radius = max([int(4 * s + 0.5) for _, s in features.values()] or [0])
    taps = {s: gaussian_taps(s, 0) for _, s in features.values() if s}
    wanted = points.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct().withColumn("__wanted", F.lit(True))
    slim = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *(F.col(b).cast("double").alias(b) for b in used))
    near = reached(slim, wanted, radius, tile)
    own = (F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))
    near = near.join(wanted, ["r", "c"], "left").withColumn("__wanted", F.coalesce(F.col("__wanted") & own, F.lit(False)))

    def one(t: pd.DataFrame) -> pd.DataFrame:
        r, c = t.r.to_numpy(np.int64), t.c.to_numpy(np.int64)
        y, x, mine = r - r.min(), c - c.min(), t["__wanted"].to_numpy(bool)
        out = pd.DataFrame({"r": r[mine].astype(np.int32), "c": c[mine].astype(np.int32)})
        padded = {}
        for b in used:
            a = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
            a[y, x] = t[b]
            padded[b] = np.pad(a, radius, mode="edge")
        for name in names:
            band, s = features[name]
            a, py, px = padded[band], y[mine] + radius, x[mine] + radius
            if not s:
                out[name] = a[py, px]
                continue
            reach = max(taps[s])
            steps = np.arange(-reach, reach + 1)
            parts = []
            for lo in range(0, len(py), 4096):  # windows of a few points at a time
                win = a[py[lo : lo + 4096, None, None] + steps[:, None], px[lo : lo + 4096, None, None] + steps]
                down = sum(taps[s][int(k)] * win[:, i, :] for i, k in enumerate(steps))
                parts.append(sum(taps[s][int(k)] * down[:, i] for i, k in enumerate(steps)))
            out[name] = np.concatenate(parts) if parts else np.empty(0)
        return out

    found = near.groupBy("tr", "tc").applyInPandas(one, "r int, c int, " + ", ".join(f"{n} double" for n in names))
    return found.select("r", "c", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))
