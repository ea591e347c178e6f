"""Distances on lattices: exact where all are asked for, by offsets where only near ones are."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import cross_offsets, offsets, table_of


def spread(df: DataFrame, moves: list[tuple], names: list[str]) -> DataFrame:
    """Rows of df at r + dr, c + dc for every move; a join with a fixed table, so the rows grow by a fixed factor."""
    kinds = ", ".join(f"{n} {'int' if n in ('dr', 'dc') else 'double'}" for n in names)
    moves_df = F.broadcast(table_of(df.sparkSession, moves, kinds))  # a fixed number of rows
    return df.crossJoin(moves_df).withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")})


def _framed(points: DataFrame, radius: int, tile: int) -> DataFrame:
    """(r, c, tr, tc): each point in every tile that it reaches."""
    reach = lambda x: F.sequence(F.floor((F.col(x) - radius) / tile).cast("int"), F.floor((F.col(x) + radius) / tile).cast("int"))
    return points.select(F.col("r").cast("int"), F.col("c").cast("int")).withColumn("tr", F.explode(reach("r"))).withColumn("tc", F.explode(reach("c")))


def around(points: DataFrame, moves: list[tuple[int, int, float]], tile: int = 512) -> DataFrame:
    """(r, c, d): all cells that a move (dr, dc, d) takes a point to, with the least d of those that do.

    One shuffle of the points; each tile lays them out with a frame and shifts
    them, so the rows that moves would make are never made.
    """
    frame = max(max(abs(i), abs(j)) for i, j, _ in moves)
    ordered = sorted(moves, key=lambda m: -m[2])  # the least comes last and stays

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(rows.tr.iloc[0]) * tile, int(rows.tc.iloc[0]) * tile
        mask = np.zeros((tile + 2 * frame,) * 2, bool)
        mask[rows.r.to_numpy() - r0 + frame, rows.c.to_numpy() - c0 + frame] = True
        d = np.full((tile, tile), np.nan)
        for i, j, x in ordered:
            d[mask[frame - i : frame - i + tile, frame - j : frame - j + tile]] = x
        y, x = np.nonzero(~np.isnan(d))
        return pd.DataFrame({"r": (y + r0).astype(np.int32), "c": (x + c0).astype(np.int32), "d": d[y, x]})

    return _framed(points, frame, tile).groupBy("tr", "tc").applyInPandas(one, "r int, c int, d double")


def near(points: DataFrame, radius: float) -> DataFrame:
    """(r, c, d) of all cells within radius of a point, with the distance to the nearest; those beyond the lattice, too."""
    return around(points, offsets(radius))


def _along_rows(cells: pa.Table) -> pa.Table:
    """d2, fr, fc and the carried value for whole rows of the lattice.

    A cell at distance d looks k cells to both sides for k up to d only, so
    the work is the sum of all distances. Rows are laid out side by side.
    """
    r, c = (cells.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
    near = cells.column("__n")
    seen = ~near.is_null().to_numpy(zero_copy_only=False)
    base, width = c.min(), int(c.max() - c.min()) + 1
    row = np.unique(r, return_inverse=True)[1]
    at = row * width + (c - base)  # each cell's place; places without a cell stay blank
    rows = int(row.max()) + 1
    gap, source = np.full(rows * width, -1, np.int64), np.zeros(rows * width, np.int64)
    n = near.fill_null(0).to_numpy().astype(np.int64)
    gap[at[seen]], source[at[seen]] = np.abs(n - r)[seen], n[seen]
    far = np.iinfo(np.int64).max
    d2 = np.where(gap >= 0, gap * gap, far)[at]
    fr, fc = source[at], c.copy()
    open_ = np.flatnonzero(np.bincount(row[seen], minlength=rows)[row] > 0)  # rows that see no marked cell have no answer
    x = c - base
    for k in range(1, width):
        open_ = open_[d2[open_] >= k * k]
        if not len(open_):
            break
        for step in (-k, k):
            i = open_[(x[open_] + step >= 0) & (x[open_] + step < width)]
            g = gap[at[i] + step]
            i, g = i[g >= 0], g[g >= 0]
            offer, row_of = g * g + k * k, source[at[i] + step]
            better = (offer < d2[i]) | ((offer == d2[i]) & ((row_of < fr[i]) | ((row_of == fr[i]) & (c[i] + step < fc[i]))))
            i = i[better]
            d2[i], fr[i], fc[i] = offer[better], row_of[better], c[i] + step
    none = d2 == far
    out = cells.drop_columns(["__n", "__v"] if "__v" in cells.column_names else ["__n"])
    for name, v, kind in (("d2", d2, pa.int64()), ("fr", fr, pa.int32()), ("fc", fc, pa.int32())):
        out = out.append_column(name, pa.array(np.where(none, 0, v), kind, mask=none))
    if "__v" in cells.column_names:
        place = np.zeros(rows * width, np.int64)
        place[at] = np.arange(len(at))
        took = place[np.where(none, at, row * width + (fc - base))]
        out = out.append_column("carried", cells.column("__v").take(pa.array(took)))
    return out


def distance(df: DataFrame, mask: Column, carry: str | None = None, rows: int = 16) -> DataFrame:
    """df with d2, the squared distance to the nearest marked cell, and fr, fc, that cell (least row, then column, among the nearest).

    Exact. First along columns: the nearest marked row above and below, by
    running windows. Then along rows, a few whole rows to a task's batch: a
    cell's columns c' compete with (c - c')**2 + gap(c')**2. carry: a band
    whose value at the nearest cell comes along as carried. All null where
    nothing is marked.
    """
    up = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("c").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(mask, F.struct(F.col("r").alias("n"), *([F.col(carry).alias("v")] if carry else [])))
    gaps = df.withColumn("__m", found)
    gaps = gaps.withColumn("__u", F.last("__m", ignorenulls=True).over(up)).withColumn("__d", F.last("__m", ignorenulls=True).over(down))
    nearest = F.when(F.col("__u").isNull(), F.col("__d")).when(F.col("__d").isNull() | (F.col("r") - F.col("__u.n") <= F.col("__d.n") - F.col("r")), F.col("__u")).otherwise(F.col("__d"))
    gaps = gaps.withColumn("__m", nearest).select(*df.columns, F.col("__m.n").cast("int").alias("__n"), *([F.col("__m.v").alias("__v")] if carry else []))
    schema = type(df.schema)(list(df.schema.fields)).add("d2", "long").add("fr", "integer").add("fc", "integer")  # add changes its own
    if carry:
        schema = schema.add("carried", df.schema[carry].dataType)
    return gaps.groupBy(F.floor(F.col("r") / rows)).applyInArrow(_along_rows, schema)


def nearest_fill(df: DataFrame, band: str, out: str) -> DataFrame:
    """out: the band, or the value of the nearest cell that has one."""
    return distance(df, F.col(band).isNotNull(), carry=band).withColumn(out, F.col("carried")).drop("d2", "fr", "fc", "carried")


def dilate(points: DataFrame, steps: int) -> DataFrame:
    """Cells that steps over edges reach from a point."""
    return around(points, [(i, j, 0.0) for i, j in cross_offsets(steps)]).select("r", "c")


def erode(df: DataFrame, mask: str, steps: int, tile: int = 512) -> DataFrame:
    """Cells of the mask whose whole cross of steps lies in it; beyond the lattice counts as outside. One shuffle of the mask to tiles with frames."""
    moves = cross_offsets(steps)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(rows.tr.iloc[0]) * tile, int(rows.tc.iloc[0]) * tile
        inside = np.zeros((tile + 2 * steps,) * 2, bool)
        inside[rows.r.to_numpy() - r0 + steps, rows.c.to_numpy() - c0 + steps] = True
        kept = np.ones((tile, tile), bool)
        for i, j in moves:
            kept &= inside[steps + i : steps + i + tile, steps + j : steps + j + tile]
        y, x = np.nonzero(kept)
        return pd.DataFrame({"r": (y + r0).astype(np.int32), "c": (x + c0).astype(np.int32)})

    return _framed(df.filter(F.col(mask)), steps, tile).groupBy("tr", "tc").applyInPandas(one, "r int, c int")


def beyond(df: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Cells of df further than radius from every point; with radius 0, those that are no point."""
    return df.join(near(points, radius).select("r", "c"), ["r", "c"], "left_anti")


def profile(df: DataFrame, marked: str, d2: str, edges: list[float], least_area: int) -> DataFrame:
    """Per band of distance (lo, hi]: area, marked cells, density, and density over the median of the usable bands."""
    band = sum((F.when(F.sqrt(d2) > e, 1).otherwise(0) for e in edges[1:]), F.when(F.sqrt(d2) > edges[0], 1).otherwise(0))
    bins = df.withColumn("bin", band).groupBy("bin").agg(F.count(F.lit(1)).alias("area"), F.count(F.when(F.col(marked), 1)).alias("hits"))
    bins = bins.withColumn("density", F.col("hits") / F.col("area"))
    usable = (F.col("area") >= least_area) & (F.col("density") > 0)
    middle = F.broadcast(bins.filter(usable).agg(F.expr("percentile(density, 0.5)").alias("middle")))
    return bins.crossJoin(middle).withColumns({"usable": usable, "rel": F.col("density") / F.col("middle")}).drop("middle")
