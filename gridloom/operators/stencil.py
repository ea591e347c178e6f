"""Stencils on dense lattices, in tiles with a frame of neighbours.

A tile holds what its stencils reach, so no task holds more than a tile and
its frame, however large the lattice is. Gaussians are taken in one Arrow pass
per tile; short stencils are windows along columns and rows of a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_taps

TILE = 512


def tiled(df: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Adds tr, tc: each cell stands in its own tile and in those whose frame of radius cells holds it."""
    def reach(x: str) -> Column:
        return F.sequence(F.floor((F.col(x) - radius) / tile).cast("int"), F.floor((F.col(x) + radius) / tile).cast("int"))

    return df.withColumn("tr", F.explode(reach("r"))).withColumn("tc", F.explode(reach("c")))


def core(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Only the cells that a tile owns."""
    return df.filter((F.col("tr") == F.floor(F.col("r") / tile)) & (F.col("tc") == F.floor(F.col("c") / tile))).drop("tr", "tc")


def down(*extra: str):
    return Window.partitionBy("tr", "tc", "c").orderBy("r")


def across():
    return Window.partitionBy("tr", "tc", "r").orderBy("c")


def _weigh(a: np.ndarray, taps: dict[int, float], axis: int) -> np.ndarray:
    """Sum of the taps along an axis; edges repeat."""
    reach = max(abs(k) for k in taps)
    p = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in range(2)], mode="edge")
    out = np.zeros_like(a)
    for k, t in sorted(taps.items()):
        out += t * (p[reach + k : reach + k + a.shape[0]] if axis == 0 else p[:, reach + k : reach + k + a.shape[1]])
    return out


def smooth(df: DataFrame, jobs: dict[str, tuple[str, float, int, int]], tile: int = TILE) -> DataFrame:
    """Adds Gaussian smooths or derivatives: result -> (band, sigma, order down, order across); edges repeat.

    One shuffle by tiles for all jobs. A cell without a value, or one that is
    missing from the lattice, gives null wherever a stencil reaches it.
    """
    radius = max(int(4 * s + 0.5) for _, s, _, _ in jobs.values())
    taps = {(s, o): gaussian_taps(s, o) for _, s, *orders in jobs.values() for o in orders}

    def one(cells: pa.Table) -> pa.Table:
        r, c = (cells.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        tr, tc = cells.column("tr")[0].as_py(), cells.column("tc")[0].as_py()
        core_ = (r // tile == tr) & (c // tile == tc)
        y, x = r - r.min(), c - c.min()
        shape = int(y.max()) + 1, int(x.max()) + 1
        down: dict[tuple, np.ndarray] = {}
        bands: dict[str, np.ndarray] = {}
        out = cells.filter(pa.array(core_)).drop_columns(["tr", "tc"])
        y_, x_ = y[core_], x[core_]
        for name, (band, s, first, second) in jobs.items():
            if band not in bands:
                bands[band] = np.full(shape, np.nan)
                bands[band][y, x] = cells.column(band).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if (band, s, first) not in down:
                down[band, s, first] = _weigh(bands[band], taps[s, first], 0)
            v = _weigh(down[band, s, first], taps[s, second], 1)[y_, x_]
            if name in out.column_names:
                out = out.drop_columns([name])
            out = out.append_column(name, pa.array(v, mask=np.isnan(v)))
        return out

    schema = type(df.schema)([f for f in df.schema.fields if f.name not in jobs])
    for k in jobs:
        schema = schema.add(k, "double")
    return tiled(df, radius, tile).groupBy("tr", "tc").applyInArrow(one, schema)


def gradient(df: DataFrame, band: str, sigma: float = 1.0) -> DataFrame:
    """gx and gy: derivatives along columns and rows of a smooth."""
    return smooth(df, {"gx": (band, sigma, 0, 1), "gy": (band, sigma, 1, 0)})


def finite_gradient(df: DataFrame, band: str, tile: int = TILE) -> DataFrame:
    """fr and fc: central differences, one-sided at the edges."""
    def diff(w) -> Column:
        a, b = F.lag(band).over(w), F.lead(band).over(w)
        return F.when(a.isNull(), b - F.col(band)).when(b.isNull(), F.col(band) - a).otherwise((b - a) / 2)

    return core(tiled(df, 1, tile).withColumns({"fr": diff(down()), "fc": diff(across())}), tile)


def hessian(df: DataFrame, band: str, sigma: float) -> DataFrame:
    """dom and tan: eigenvalues of the Hessian, the one of larger magnitude first; largest: the larger one."""
    out = smooth(df, {"hxx": (band, sigma, 0, 2), "hyy": (band, sigma, 2, 0), "hxy": (band, sigma, 1, 1)})
    half = (F.col("hxx") + F.col("hyy")) / 2
    root = F.sqrt((F.col("hxx") - F.col("hyy")) * (F.col("hxx") - F.col("hyy")) / 4 + F.col("hxy") * F.col("hxy"))
    out = out.withColumns({"__a": half + root, "__b": half - root})
    first = F.abs("__a") >= F.abs("__b")
    return out.withColumns({"dom": F.when(first, F.col("__a")).otherwise(F.col("__b")), "tan": F.when(first, F.col("__b")).otherwise(F.col("__a")), "largest": F.col("__a")}).drop("__a", "__b", "hxx", "hyy", "hxy")


def line_response(df: DataFrame, band: str, sigma: float, sign: int = -1) -> DataFrame:
    """line: ridges (-1), valleys (+1) or both (0), times how much longer than wide they are to the power 1.5."""
    out = hessian(df, band, sigma)
    r = {-1: F.greatest(-F.col("dom"), F.lit(0.0)), 1: F.greatest(F.col("dom"), F.lit(0.0)), 0: F.abs("dom")}[sign]
    shape = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs("tan") / (F.abs("dom") + 1e-9)))
    return out.withColumn("line", r * F.pow(shape, F.lit(1.5)))


def ridge(df: DataFrame, band: str, sigma: float) -> DataFrame:
    """ridge: minus the larger eigenvalue where that is above zero, so both curvatures must be negative."""
    return hessian(df, band, sigma).withColumn("ridge", F.greatest(-F.col("largest"), F.lit(0.0)))


def structure(df: DataFrame, band: str, sigma: float, spread: float | None = None) -> DataFrame:
    """coherence (half the contrast over the trace) and angle of the structure tensor of a gradient, spread by a second Gaussian."""
    out = gradient(df, band, sigma)
    out = out.withColumns({"jxx": F.col("gx") * F.col("gx"), "jyy": F.col("gy") * F.col("gy"), "jxy": F.col("gx") * F.col("gy")})
    s = spread or sigma
    out = smooth(out, {"sxx": ("jxx", s, 0, 0), "syy": ("jyy", s, 0, 0), "sxy": ("jxy", s, 0, 0)}).drop("jxx", "jyy", "jxy")
    d = F.col("sxx") - F.col("syy")
    root = F.sqrt(d * d / 4 + F.col("sxy") * F.col("sxy"))
    return out.withColumns({"coherence": root / (F.col("sxx") + F.col("syy") + 1e-12), "angle": 0.5 * F.atan2(2 * F.col("sxy"), d)})


def coherence(df: DataFrame, band: str, sigma: float, spread: float) -> DataFrame:
    """coherence as the contrast of the structure tensor over its trace: 0 where no direction stands out, 1 on a straight edge."""
    return structure(df, band, sigma, spread).withColumn("coherence", 2 * F.col("coherence")).drop("angle", "gx", "gy", "sxx", "syy", "sxy")


def fused_strike(df: DataFrame, bands: list[str], sigmas: tuple[float, ...], spread: float = 3.0) -> DataFrame:
    """strike (azimuth, 0 to 180) and coherence of the sum of the structure tensors of several bands and scales, each over its own mean trace so that no unit weighs more."""
    jobs = {f"__{x}{i}_{k}": (b, s, *o) for i, b in enumerate(bands) for k, s in enumerate(sigmas) for x, o in (("x", (0, 1)), ("y", (1, 0)))}
    out = smooth(df, jobs)
    pairs = [(f"__x{i}_{k}", f"__y{i}_{k}") for i in range(len(bands)) for k in range(len(sigmas))]
    energy = F.broadcast(out.agg(*(F.avg(F.col(x) * F.col(x) + F.col(y) * F.col(y)).alias(f"__m{n}") for n, (x, y) in enumerate(pairs))))  # one row
    out = out.crossJoin(energy)
    total = lambda f: sum((f(x, y) / (F.col(f"__m{n}") + 1e-12) for n, (x, y) in enumerate(pairs)), F.lit(0.0))
    out = out.withColumns({"__xx": total(lambda x, y: F.col(x) * F.col(x)), "__yy": total(lambda x, y: F.col(y) * F.col(y)), "__xy": total(lambda x, y: F.col(x) * F.col(y))})
    out = smooth(out.select(*df.columns, "__xx", "__yy", "__xy"), {"__sx": ("__xx", spread, 0, 0), "__sy": ("__yy", spread, 0, 0), "__sc": ("__xy", spread, 0, 0)})
    d = F.col("__sx") - F.col("__sy")
    # the gradient's axis has half the angle of the tensor's; the line it crosses is a quarter turn away, and azimuths turn the other way round
    axis = F.degrees(F.atan2(2 * F.col("__sc"), d)) / 2
    made = {"strike": F.pmod(axis + 180, F.lit(180.0)), "coherence": F.sqrt(d * d + 4 * F.col("__sc") * F.col("__sc")) / (F.col("__sx") + F.col("__sy") + 1e-12)}
    return out.withColumns(made).select(*df.columns, *made)


def strike(gx: str, gy: str) -> Column:
    """Azimuth in degrees, 0 to 180, of the line that a gradient crosses."""
    return F.pmod(F.degrees(F.atan2(F.col(gx), -F.col(gy))) + 90, F.lit(180.0))


def analytic_signal(df: DataFrame, band: str, height: float, cell: float = 100.0) -> DataFrame:
    """signal: of the band continued upward by height: root of the squares of both slopes and the vertical one."""
    sigma, outer = max(height / cell / math.sqrt(2), 0.5), max(height / cell, 0.8)
    out = smooth(df, {"up": (band, sigma, 0, 0)})
    out = finite_gradient(out, "up")
    out = smooth(out, {"lxx": ("up", outer, 0, 2), "lyy": ("up", outer, 2, 0)})
    gx, gy, gz = F.col("fc") / cell, F.col("fr") / cell, (F.col("lxx") + F.col("lyy")) * cell
    return out.withColumn("signal", F.sqrt(gx * gx + gy * gy + gz * gz)).drop("up", "fr", "fc", "lxx", "lyy")


def occupancy(df: DataFrame, mask: str, half: int = 4, tile: int = TILE) -> DataFrame:
    """vote: the largest share of marked cells on a stretch of 2 * half + 1 along a row, a column or a diagonal; outside counts as unmarked."""
    out = tiled(df.withColumn("__m", F.col(mask).cast("int")), half, tile)
    rows = lambda w: F.sum("__m").over(w.rangeBetween(-half, half)) / (2 * half + 1)
    along = [across(), down(), Window.partitionBy("tr", "tc", F.col("r") - F.col("c")).orderBy("r"), Window.partitionBy("tr", "tc", F.col("r") + F.col("c")).orderBy("r")]
    return core(out.withColumn("vote", F.greatest(*map(rows, along))).drop("__m"), tile)


def extrema(df: DataFrame, band: str, half: int = 3, tile: int = TILE) -> DataFrame:
    """lo and hi of the square of 2 * half + 1 cells around each cell."""
    out = tiled(df, half, tile)
    w = lambda v: v.rowsBetween(-half, half)
    out = out.withColumns({"__lo": F.min(band).over(w(down())), "__hi": F.max(band).over(w(down()))})
    return core(out.withColumns({"lo": F.min("__lo").over(w(across())), "hi": F.max("__hi").over(w(across()))}).drop("__lo", "__hi"), tile)


def openness(df: DataFrame, band: str, reach: int = 3, tile: int = TILE) -> DataFrame:
    """open: 90 degrees less the mean over eight directions of the steepest angle up to reach cells away; cells outside don't count."""
    steps = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    out = tiled(df, reach, tile)
    lines = {(0, 1): across(), (1, 0): down(), (1, 1): Window.partitionBy("tr", "tc", F.col("r") - F.col("c")).orderBy("r"), (1, -1): Window.partitionBy("tr", "tc", F.col("r") + F.col("c")).orderBy("r")}
    angles = {}
    for i, (dr, dc) in enumerate(steps):
        forward = (dr, dc) in lines
        w = lines[(dr, dc) if forward else (-dr, -dc)]
        slopes = []
        for k in range(1, reach + 1):
            v = (F.lead if forward else F.lag)(band, k).over(w)
            slopes.append(F.degrees(F.atan((v - F.col(band)) / (k * math.hypot(dr, dc)))))
        angles[f"__a{i}"] = F.greatest(*slopes)
    out = out.withColumns(angles)
    some = [F.coalesce(F.col(k), F.lit(0.0)) for k in angles]
    return core(out.withColumn("open", 90 - sum(some[1:], some[0]) / sum((F.col(k).isNotNull().cast("int") for k in list(angles)[1:]), F.col("__a0").isNotNull().cast("int"))).drop(*angles), tile)


def openness_asymmetry(df: DataFrame, band: str, out: str = "asym", away: float = 3.0, directions: int = 8, tile: int = TILE) -> DataFrame:
    """out: the steepest angle up less the steepest angle down (radians, 0 at least) among places at a distance in so many directions.

    Places between cells are bilinear; beyond the lattice its edges repeat. A
    cell without a value gives null wherever a place needs it.
    """
    frame = math.ceil(away) + 1
    places = [(-away * math.sin(2 * math.pi * k / directions), away * math.cos(2 * math.pi * k / directions)) for k in range(directions)]

    def one(cells: pa.Table) -> pa.Table:
        r, c = (cells.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        tr, tc = cells.column("tr")[0].as_py(), cells.column("tc")[0].as_py()
        mine = (r // tile == tr) & (c // tile == tc)
        y, x = r - r.min(), c - c.min()
        a = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        a[y, x] = cells.column(band).cast(pa.float64()).to_numpy(zero_copy_only=False)
        p = np.pad(a, frame, mode="edge")
        y, x = y[mine] + frame, x[mine] + frame
        here, up, down_ = p[y, x], np.zeros(len(y)), np.zeros(len(y))
        for dy, dx in places:
            value = sum(w * p[y + i, x + j] for i, j, w in bilinear(dy, dx))
            up = np.maximum(up, np.arctan2(value - here, away))
            down_ = np.maximum(down_, np.arctan2(here - value, away))
        v = up - down_
        kept = cells.filter(pa.array(mine)).drop_columns(["tr", "tc", *([out] if out in cells.column_names else [])])
        return kept.append_column(out, pa.array(v, mask=np.isnan(v)))

    schema = type(df.schema)([f for f in df.schema.fields if f.name != out]).add(out, "double")
    return tiled(df, frame, tile).groupBy("tr", "tc").applyInArrow(one, schema)


def bilinear(dy: float, dx: float) -> list[tuple[int, int, float]]:
    """(rows, columns, weight) of the cells around a place, without those of no weight."""
    i, j = math.floor(round(dy, 9)), math.floor(round(dx, 9))
    fy, fx = round(dy, 9) - i, round(dx, 9) - j
    four = [(i, j, (1 - fy) * (1 - fx)), (i, j + 1, (1 - fy) * fx), (i + 1, j, fy * (1 - fx)), (i + 1, j + 1, fy * fx)]
    return [(a, b, w) for a, b, w in four if w > 0]


def two_scale(df: DataFrame, value: str, weight: str, sigma: float, wide: float) -> DataFrame:
    """filled: weighted smooth where its weight is above 1e-9, else that of the wide smooth, else the mean."""
    out = df.withColumns({"__v": F.coalesce(F.col(value) * F.col(weight), F.lit(0.0)), "__w": F.coalesce(F.col(weight).cast("double"), F.lit(0.0))})
    out = smooth(out, {"__vs": ("__v", sigma, 0, 0), "__ws": ("__w", sigma, 0, 0), "__vl": ("__v", wide, 0, 0), "__wl": ("__w", wide, 0, 0)})
    mean = F.broadcast(df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("__mean")))  # one row
    out = out.crossJoin(mean)
    filled = F.when(F.col("__ws") > 1e-9, F.col("__vs") / F.col("__ws")).when(F.col("__wl") > 1e-9, F.col("__vl") / F.col("__wl")).otherwise(F.col("__mean"))
    return out.withColumn("filled", filled).drop("__v", "__w", "__vs", "__ws", "__vl", "__wl", "__mean")
