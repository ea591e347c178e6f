"""Thinning of masks, strikes at trace ends, and corridors painted from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import offsets
from ..session import settle
from .components import tips
from .distance import spread
from .stencil import tiled

def _peel(mask: np.ndarray, second: bool) -> np.ndarray:
    """Cells that one half of a round takes: edge cells with two to six neighbours in one stretch around them, on the lower right or the upper left side."""
    p = np.pad(mask, 1)
    n, ne, e, se, s, sw, w, nw = (p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
    ring = [n, ne, e, se, s, sw, w, nw]
    many = np.sum(ring, axis=0, dtype=np.int8)
    turns = np.sum([~a & b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], axis=0, dtype=np.int8)
    side = ~(n & e & w) & ~(n & s & w) if second else ~(n & e & s) & ~(e & s & w)
    return mask & (many >= 2) & (many <= 6) & (turns == 1) & side


def thin(points: DataFrame, tile: int = 512, frame: int = 64) -> DataFrame:
    """(r, c) of the skeleton of a mask: edge cells go, side by side in turns, as long as their going parts nothing (Zhang and Suen's rule), until none is left to go.

    A half of a round reaches one cell, so a tile with a frame of neighbours
    runs as many as the frame is wide, and only what still changes needs
    another pass.
    """
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(rows.tr.iloc[0]) * tile - frame, int(rows.tc.iloc[0]) * tile - frame
        mask = np.zeros((tile + 2 * frame,) * 2, bool)
        mask[rows.r.to_numpy() - r0, rows.c.to_numpy() - c0] = True
        moving = False
        for _ in range(frame // 2):
            moving = False
            for second in (False, True):
                gone = _peel(mask, second)
                moving |= bool(gone.any())
                mask &= ~gone
            if not moving:
                break
        y, x = np.nonzero(mask[frame : frame + tile, frame : frame + tile])
        return pd.DataFrame({"r": (y + r0 + frame).astype(np.int32), "c": (x + c0 + frame).astype(np.int32), "moving": moving})

    cells = settle(points.select(F.col("r").cast("int"), F.col("c").cast("int")).distinct())
    while True:
        cells = settle(tiled(cells, frame, tile).groupBy("tr", "tc").applyInPandas(one, "r int, c int, moving boolean"))
        if not cells.filter("moving").limit(1).count():
            return cells.select("r", "c")
        cells = cells.select("r", "c")


def tip_strikes(labelled: DataFrame, reach: int = 6, least: int = 25, few: int = 4) -> DataFrame:
    """(r, c, comp, strike): azimuth of the main axis of a component's cells within reach of each of its tips; tips with fewer than few such cells are left out."""
    ends = tips(labelled, least).select("comp", F.col("r").alias("tr"), F.col("c").alias("tc"))
    moves = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    seen = spread(ends.withColumns({"r": F.col("tr"), "c": F.col("tc")}), moves, ["dr", "dc"]).join(labelled, ["r", "c", "comp"])
    m = seen.groupBy("comp", "tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mr"), F.avg("c").alias("mc"), F.avg(F.col("r") * F.col("r")).alias("rr"), F.avg(F.col("c") * F.col("c")).alias("cc"), F.avg(F.col("r") * F.col("c")).alias("rc"))
    # second moments with y to the north; the axis makes half the angle of the tensor's, and an azimuth is counted from north to east
    vx, vy, vxy = F.col("cc") - F.col("mc") * F.col("mc"), F.col("rr") - F.col("mr") * F.col("mr"), -(F.col("rc") - F.col("mr") * F.col("mc"))
    axis = F.degrees(F.atan2(2 * vxy, vx - vy)) / 2
    return m.filter(F.col("n") >= few).select(F.col("tr").alias("r"), F.col("tc").alias("c"), "comp", F.pmod(90 - axis, F.lit(180.0)).alias("strike"))


def corridors(ends: DataFrame, strike: Column, steps: int = 60, half_width: float = 3.0) -> DataFrame:
    """(r, c, value): half-lines both ways along the strike of each end, falling off with the step, widened to discs; the most of all counts."""
    rad = F.radians(strike)
    line = ends.withColumn("k", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).select(
        F.bround(F.col("r") - F.col("k") * F.cos(rad), 0).cast("int").alias("r"), F.bround(F.col("c") + F.col("k") * F.sin(rad), 0).cast("int").alias("c"), (1 - F.abs("k") / (steps + 1)).alias("w")
    )
    line = line.groupBy("r", "c").agg(F.max("w").alias("w"))
    discs = [(i, j, 1 - d / (half_width + 1)) for i, j, d in offsets(half_width)]
    return spread(line, discs, ["dr", "dc", "f"]).groupBy("r", "c").agg(F.max(F.col("w") * F.col("f")).alias("value"))
