"""Detectors: named recipes of stencils, scales and fusions over bands.

A detector takes a dense lattice and gives it one more column, score. The
registry maps a name to (what it is, bands it needs, function), so a caller's
own detector is one entry more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import normalise as N
from . import stencil as S
from ..session import settle


def _domain(df: DataFrame):
    return F.col("foot")


def cross_gradient(df: DataFrame, bands: list[str], sigma: float = 1.5) -> DataFrame:
    """Where the edges of all bands coincide and point alike: product of edges over their 0.99 quantile, times orientation agreement ** 1.5."""
    jobs = {f"{x}{b}": (b, sigma, *o) for b in bands for x, o in (("gx_", (0, 1)), ("gy_", (1, 0)))}
    out = S.smooth(df, jobs)
    out = out.withColumns({f"e_{b}": F.sqrt(F.col(f"gx_{b}") * F.col(f"gx_{b}") + F.col(f"gy_{b}") * F.col(f"gy_{b}")) for b in bands})
    out = settle(out, "edges")  # read by three passes
    out = out.crossJoin(F.broadcast(N.quantile_row(out, {f"q_{b}": (f"e_{b}", 0.99) for b in bands}, _domain(out))))  # one row
    strength, cw, cx, cy = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for b in bands:
        e = F.col(f"e_{b}")
        strength = strength + F.log(0.05 + e / (F.col(f"q_{b}") + 1e-12))
        nx, ny = F.col(f"gx_{b}") / (e + 1e-12), F.col(f"gy_{b}") / (e + 1e-12)
        cx, cy, cw = cx + e * (nx * nx - ny * ny), cy + e * 2 * nx * ny, cw + e
    agree = F.sqrt(cx * cx + cy * cy) / (cw + 1e-12)
    return out.withColumn("score", F.exp(strength / len(bands)) * F.pow(agree, F.lit(1.5))).select(*df.columns, "score")


def zero_crossing(df: DataFrame, band: str, sigma: float = 1.0) -> DataFrame:
    """Steep where the band is near zero against its own spread: |gradient| exp(-(v / s)**2 / 2), s the 0.9 quantile of |v|."""
    out = S.gradient(df.withColumn("__abs", F.abs(band)), band, sigma)
    q = F.broadcast(N.quantiles(out, "__abs", [0.9], _domain(out)))
    out = out.crossJoin(q)
    v = F.col(band) / (F.col("q0") + 1e-12)
    return out.withColumn("score", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * F.exp(-0.5 * v * v)).select(*df.columns, "score")


def co_edge(df: DataFrame, a: str, b: str, sigma: float = 1.0) -> DataFrame:
    """Product of two bands' scaled edges times the squared cosine between them."""
    out = S.smooth(df, {"ax": (a, sigma, 0, 1), "ay": (a, sigma, 1, 0), "bx": (b, sigma, 0, 1), "by": (b, sigma, 1, 0)})
    out = out.withColumns({"ea": F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")), "eb": F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by"))})
    cosine = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / (F.col("ea") * F.col("eb") + 1e-12)
    out = out.withColumn("cos2", cosine * cosine)
    out = N.robust_units(settle(out, "edges"), {"ua": "ea", "ub": "eb"}, _domain(out))
    return out.withColumn("score", F.col("ua") * F.col("ub") * F.col("cos2")).select(*df.columns, "score")


def incumbent_ridge(df: DataFrame, ridge: str, a: str, b: str, sigma: float = 1.5) -> DataFrame:
    """Scaled ridge times 0.55 + 0.25 a + 0.20 b, both scaled."""
    out = S.line_response(df, ridge, sigma, -1)
    out = N.robust_units(settle(out, "lines"), {"ur": "line", "ua": a, "ub": b}, _domain(out))
    return out.withColumn("score", F.col("ur") * (0.55 + 0.25 * F.col("ua") + 0.2 * F.col("ub"))).select(*df.columns, "score")


def strain_corridor(df: DataFrame, amplitude: str, ridge: str, dilation: str, sigma: float = 1.5) -> DataFrame:
    """0.5 amplitude + 0.3 ridge + 0.2 local range of dilation over 7 x 7 cells, each scaled."""
    out = S.extrema(S.line_response(df, ridge, sigma, 0), dilation).withColumn("range", F.col("hi") - F.col("lo"))
    out = N.robust_units(settle(out, "lines"), {"ua": amplitude, "ur": "line", "ud": "range"}, _domain(out))
    return out.withColumn("score", 0.5 * F.col("ua") + 0.3 * F.col("ur") + 0.2 * F.col("ud")).select(*df.columns, "score")


def worm(df: DataFrame, band: str, heights: tuple[float, ...] = (100.0, 200.0), sigma: float = 1.5) -> DataFrame:
    """Mean over continuation heights of the ridge of the logarithm of the analytic signal, scaled."""
    out, total = df, F.lit(0.0)
    for i, h in enumerate(heights):
        out = S.analytic_signal(out, band, h).withColumn(f"s{i}", F.log1p("signal")).drop("signal")
        out = S.line_response(out, f"s{i}", sigma, -1).withColumn(f"l{i}", F.col("line")).drop("line", "dom", "tan", "largest")
        out = N.robust_unit(out, f"l{i}", f"u{i}", _domain(out))
        total = total + F.col(f"u{i}")
    return out.withColumn("score", total / len(heights)).select(*df.columns, "score")


def radiometric_cosine(df: DataFrame, ratios: list[str], conductivity: str, sigma: float = 1.0) -> DataFrame:
    """Root of the strongest ratio's edge times the conductivity's, both scaled, times |cos| between them; of equal edges the first ratio counts."""
    names = [*ratios, conductivity]
    out = S.smooth(df, {f"{x}{b}": (b, sigma, *o) for b in names for x, o in (("gx_", (0, 1)), ("gy_", (1, 0)))})
    edge = lambda b: F.sqrt(F.col(f"gx_{b}") * F.col(f"gx_{b}") + F.col(f"gy_{b}") * F.col(f"gy_{b}"))
    best = F.struct(edge(ratios[0]).alias("e"), F.col(f"gx_{ratios[0]}").alias("x"), F.col(f"gy_{ratios[0]}").alias("y"))
    out = out.withColumn("best", best)
    for b in ratios[1:]:
        out = out.withColumn("best", F.when(edge(b) > F.col("best.e"), F.struct(edge(b).alias("e"), F.col(f"gx_{b}").alias("x"), F.col(f"gy_{b}").alias("y"))).otherwise(F.col("best")))
    out = out.withColumns({"ratio_edge": F.col("best.e"), "cond_edge": edge(conductivity)})
    out = N.robust_units(settle(out, "edges"), {"ur": "ratio_edge", "uc": "cond_edge"}, _domain(out))
    cosine = (F.col("best.x") * F.col(f"gx_{conductivity}") + F.col("best.y") * F.col(f"gy_{conductivity}")) / (F.col("ratio_edge") * F.col("cond_edge") + 1e-12)
    return out.withColumn("score", F.sqrt(F.col("ur") * F.col("uc")) * F.abs(cosine)).select(*df.columns, "score")


def favourability(relative: str, value: str, df: DataFrame, bins: int = 36) -> DataFrame:
    """Mean value by the angle to the stress axis, folded to 0..90 degrees; empty bins take the mean of the others."""
    angle = F.pmod(F.col(relative), F.lit(180.0))
    folded = F.least(angle, 180 - angle)
    binned = df.select(F.least(F.floor(folded / (90.0 / bins)), F.lit(bins - 1)).cast("int").alias("bin"), F.col(value).alias("v")).groupBy("bin").agg(F.avg("v").alias("v"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    mean = F.broadcast(binned.agg(F.avg("v").alias("m")))
    return every.join(binned, "bin", "left").crossJoin(mean).select("bin", ((F.col("bin") + 0.5) * 90.0 / bins).alias("centre"), F.coalesce("v", "m").alias("value"))


def stress_gate(df: DataFrame, band: str, azimuth: float, curve: DataFrame, sigma: float = 1.5, bins: int = 36) -> DataFrame:
    """Edge strength times (0.25 + 0.75 coherence) times (0.3 + 0.7 favourability of the strike against the stress axis)."""
    out = S.structure(df, band, sigma).withColumns({"edge": F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), "strike": S.strike("gx", "gy")})
    out = N.robust_unit(out, "edge", "ue", _domain(out))
    rel = F.pmod(F.col("strike") - (azimuth + 90), F.lit(180.0))
    out = out.withColumn("bin", F.least(F.floor(F.least(rel, 180 - rel) / (90.0 / bins)), F.lit(bins - 1)).cast("int"))
    out = out.join(F.broadcast(curve.select("bin", F.col("value").alias("fav"))), "bin", "left")  # one row per bin
    coherent = F.least(2 * F.col("coherence"), F.lit(1.0))
    return out.withColumn("score", F.col("ue") * (0.25 + 0.75 * coherent) * (0.3 + 0.7 * F.coalesce("fav", F.lit(0.5)))).select(*df.columns, "score")


def residual(df: DataFrame, band: str, sigma: float) -> DataFrame:
    """The band less its local mean, cells outside filled with the mean of the domain."""
    mean = F.broadcast(df.filter(_domain(df)).agg(F.avg(band).alias("m")))
    out = df.crossJoin(mean).withColumn("__f", F.when(F.col("foot") & F.col(band).isNotNull(), F.col(band)).otherwise(F.col("m")))
    out = S.smooth(out, {"local": ("__f", sigma, 0, 0)})
    return out.withColumn("score", F.when(F.col("foot"), F.col("__f") - F.col("local")).otherwise(0.0)).select(*df.columns, "score")


def backbone(df: DataFrame, bands: list[str], sigmas: tuple[float, ...] = (1.5, 3.0)) -> DataFrame:
    """Harmonic fusion of the ranks of every band's ridges at every scale."""
    out, names = df, []
    for b in bands:
        for s in sigmas:
            k = f"k{len(names)}"
            out = S.line_response(out, b, s, 0).withColumn(f"{k}v", F.col("line")).drop("line", "dom", "tan", "largest")
            names.append(k)
    inside = settle(out.filter("foot"), "ridges")
    ranks = N.rank_units(inside, {k: f"{k}v" for k in names}, F.lit(True))
    return inside.join(ranks, ["r", "c"]).withColumn("score", N.harmonic_fusion(dict.fromkeys(names, 1.0))).select(*df.columns, "score")


DETECTORS: dict[str, tuple[str, list[str], Callable]] = {
    "cross_gradient": ("edges that coincide and agree", ["px", "tax"], lambda df: cross_gradient(df, ["px", "tax"])),
    "zero_crossing": ("steep where near zero", ["px"], lambda df: zero_crossing(df, "px")),
    "co_edge": ("parallel edges of two bands", ["px", "tax"], lambda df: co_edge(df, "px", "tax")),
    "ridge_incumbent": ("ridge lifted by two bands", ["px", "n", "disc"], lambda df: incumbent_ridge(df, "px", "n", "disc")),
    "strain_corridor": ("amplitude, ridge and local range", ["px", "tax", "disc"], lambda df: strain_corridor(df, "px", "tax", "disc")),
    "worm": ("multi-height ridges of the analytic signal", ["px"], lambda df: worm(df, "px")),
    "backbone": ("rank consensus of ridges", ["px", "tax"], lambda df: backbone(df, ["px", "tax"], (1.5,))),
    "radiometric_cosine": ("ratio edges along conductivity edges", ["px", "tax", "disc"], lambda df: radiometric_cosine(df, ["px", "tax"], "disc")),
}
