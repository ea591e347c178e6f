"""Composite fields: recipes over several bands, stacks of derived features, and the algebra of candidate fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import normalise as N
from . import stencil as S
from .components import components
from .corridor import corridors, tip_strikes
from .distance import near


def _foot() -> Column:
    return F.col("foot")


def _mean(names: list[str]) -> Column:
    return sum((F.col(x) for x in names[1:]), F.col(names[0])) / len(names)


def _norm(a: str, b: str) -> Column:
    return F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))


def lines(df: DataFrame, band: str, sigmas: tuple[float, ...], sign: int, prefix: str) -> DataFrame:
    """Adds a column prefix0, prefix1, ... with the line response at each scale."""
    out = df
    for i, s in enumerate(sigmas):
        out = S.line_response(out, band, s, sign).withColumn(f"{prefix}{i}", F.col("line")).drop("line", "dom", "tan", "largest")
    return out


def slopes(df: DataFrame, jobs: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds for each out -> (band, sigma) the magnitude of the gradient; all share two windows."""
    pairs = {f"__{x}{out}": (band, s, *o) for out, (band, s) in jobs.items() for x, o in (("x", (0, 1)), ("y", (1, 0)))}
    out = S.smooth(df, pairs)
    return out.withColumns({name: _norm(f"__x{name}", f"__y{name}") for name in jobs}).drop(*pairs)


def stepover(df: DataFrame, height: str, slope: str, scarp: str | None = None, sigmas: tuple[float, ...] = (1.5, 3.0), half: int = 3) -> DataFrame:
    """score: ridges of height and breaks of slope in equal parts, times 0.4 + 0.6 of how they line up, times 0.6 + 0.8 scarp; scaled at the end."""
    out = lines(df, height, sigmas, -1, "__l")
    for i, s in enumerate(sigmas):
        out = S.smooth(out, {"__s": (slope, s, 0, 0)})
        out = S.finite_gradient(out, "__s").withColumn(f"__b{i}", _norm("fr", "fc")).drop("__s", "fr", "fc")
    jobs = {f"__ul{i}": f"__l{i}" for i in range(len(sigmas))} | {f"__ub{i}": f"__b{i}" for i in range(len(sigmas))}
    out = N.robust_units(settle(out, "stepover"), jobs | ({"__us": scarp} if scarp else {}), _foot())
    total = F.lit(0.0)
    for i in range(len(sigmas)):
        out = S.occupancy(out.withColumn("__m", F.col(f"__ul{i}") > 0.03), "__m", half).withColumnRenamed("vote", f"__v{i}").drop("__m")
        total = total + (0.5 * F.col(f"__ul{i}") + 0.5 * F.col(f"__ub{i}")) * (0.4 + 0.6 * F.col(f"__v{i}"))
    field = total / len(sigmas) * (0.6 + 0.8 * (F.col("__us") if scarp else F.lit(0.0)))
    return N.robust_unit(settle(out.withColumn("__t", field), "stepover"), "__t", "score", _foot()).select(*df.columns, "score")


def tilt_edge(df: DataFrame, tilt: str, a: str, b: str, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """score: mean scaled slope of tilt over scales, times 0.5 + 0.5 of the slope of the mean of two bands; scaled at the end."""
    out = df.withColumn("__ab", 0.5 * (F.col(a) + F.col(b)))
    jobs = {f"__t{i}": (tilt, s) for i, s in enumerate(sigmas)} | {"__g": ("__ab", 1.5)}
    out = settle(slopes(out, jobs), "tilt")
    out = N.robust_units(out, {f"u{k}": k for k in jobs}, _foot())
    field = _mean([f"u__t{i}" for i in range(len(sigmas))]) * (0.5 + 0.5 * F.col("u__g"))
    return N.robust_unit(settle(out.withColumn("__f", field), "tilt"), "__f", "score", _foot()).select(*df.columns, "score")


def worm_persistence(df: DataFrame, band: str, heights: tuple[float, ...] = (0.0, 250.0, 600.0, 1000.0), sigmas: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """worm: mean scaled ridge of the logarithm of the analytic signal over heights and scales; persist: that logarithm at the last height less at the first."""
    out, names = df, []
    for i, h in enumerate(heights):
        out = S.analytic_signal(out, band, h).withColumn(f"__a{i}", F.log1p("signal")).drop("signal")
    out = settle(out, "worm")
    for i in range(len(heights)):
        out = lines(out, f"__a{i}", sigmas, -1, f"__w{i}_")
        names += [f"__w{i}_{k}" for k in range(len(sigmas))]
    out = N.robust_units(settle(out, "worm"), {f"u{k}": k for k in names}, _foot())
    return out.withColumns({"worm": _mean([f"u{k}" for k in names]), "persist": F.col(f"__a{len(heights) - 1}") - F.col("__a0")}).select(*df.columns, "worm", "persist")


def strain_kink(df: DataFrame, invariant: str, shear: str, dilation: str, density: str, away: str, sigmas: tuple[float, ...] = (2.0, 4.0, 8.0)) -> DataFrame:
    """score: kinks of a strain field, lineaments of event density and dilation (0.45, 0.35, 0.20), times nearness to events and shear; over its extreme quantile at the end."""
    out, names = df, []
    for i, s in enumerate(sigmas):
        out = S.smooth(out, {"__g": (invariant, s, 0, 0)})
        out = S.hessian(out, "__g", s).withColumns({f"__d{i}": F.abs("dom"), f"__k{i}": F.abs("dom") / (F.abs("dom") + F.abs("tan") + 1e-12)}).drop("__g", "dom", "tan", "largest")
        names.append(i)
    out = S.structure(out.withColumn("__e", F.log1p(F.greatest(F.col(density), F.lit(0.0)))), "__e", 3.0).withColumn("__coh", 2 * F.col("coherence")).drop("coherence", "angle", "gx", "gy", "sxx", "syy", "sxy", "__e")
    out = out.withColumn("__near", -F.col(away))
    first = {f"__ud{i}": f"__d{i}" for i in names} | {"__ue": density, "__ul": dilation, "__us": shear, "__up": "__near"}
    out = N.robust_units(settle(out, "strain"), first, _foot())
    out = out.withColumns({f"__q{i}": F.col(f"__k{i}") * F.col(f"__ud{i}") for i in names} | {"__line": F.col("__coh") * F.col("__ue")})
    out = N.robust_units(settle(out, "strain"), {f"__uq{i}": f"__q{i}" for i in names} | {"__uline": "__line"}, _foot())
    field = (0.45 * _mean([f"__uq{i}" for i in names]) + 0.35 * F.col("__uline") + 0.2 * F.col("__ul")) * (0.5 + 0.5 * F.col("__up")) * (0.7 + 0.3 * F.col("__us"))
    return N.tie_free(settle(out.withColumn("__f", field), "strain"), "__f", "score", _foot()).select(*df.columns, "score")


def structural(df: DataFrame, height: str, magnetic: tuple[str, str], other: tuple[str, str], tilt: str) -> DataFrame:
    """score: cube root of the product of three families, each lifted by how it lines up: ridges of height, slopes of two bands, slopes of two others; scaled at the end."""
    out = df
    for i, s in enumerate((1.5, 3.0)):
        out = S.ridge(out, height, s).withColumn(f"__r{i}", F.col("ridge")).drop("ridge", "dom", "tan", "largest")
    out = S.ridge(out, tilt, 2.0).withColumn("__r2", F.col("ridge")).drop("ridge", "dom", "tan", "largest")
    for i, (band, s, wide) in enumerate(((height, 1.0, 3.0), (magnetic[1], 1.5, 4.0))):
        out = S.structure(out, band, s, wide).withColumn(f"__c{i}", 2 * F.col("coherence")).drop("coherence", "angle", "gx", "gy", "sxx", "syy", "sxy")
    out = slopes(out, {f"__m{i}": (b, 1.5) for i, b in enumerate((*magnetic, *other))})
    parts = ["__r0", "__r1", "__r2", "__c0", "__c1", "__m0", "__m1", "__m2", "__m3"]
    out = N.robust_units(settle(out, "structural"), {f"u{k}": k for k in parts}, _foot())
    topo = _mean(["u__r0", "u__r1"]) * (0.6 + 0.4 * F.col("u__c0"))
    mag = _mean(["u__m0", "u__m1"]) * (0.6 + 0.4 * F.col("u__c1"))
    rest = _mean(["u__m2", "u__m3"]) * (0.6 + 0.4 * F.col("u__r2"))
    field = F.pow((topo + 1e-3) * (mag + 1e-3) * (rest + 1e-3), F.lit(1 / 3))
    return N.robust_unit(settle(out.withColumn("__f", field), "structural"), "__f", "score", _foot()).select(*df.columns, "score")


def tip_corridor(df: DataFrame, mask: Column, steps: int = 60, half_width: float = 3.0, least: int = 25, exclude: float = 2.0) -> DataFrame:
    """(r, c, value): corridors along the strikes at the ends of a mask's traces, within the footprint and further than exclude from the mask."""
    traces = settle(components(df.filter(mask).select("r", "c")), "traces")
    painted = corridors(tip_strikes(traces, least=least), F.col("strike"), steps, half_width)
    taken = near(df.filter(mask), exclude).select("r", "c")
    return df.filter(_foot()).select("r", "c").join(painted, ["r", "c"]).join(taken, ["r", "c"], "left_anti")


def thermal(df: DataFrame, band: str, sigma: float, hot: str | None = None) -> DataFrame:
    """score: what a band holds above its local mean, scaled, times 0.5 + 0.5 of a second band where one is given."""
    from .detectors import residual

    out = residual(df, band, sigma).withColumn("__x", F.greatest(F.col("score"), F.lit(0.0))).drop("score")
    out = N.robust_units(settle(out, "thermal"), {"__u": "__x"} | ({"__h": hot} if hot else {}), _foot())
    return out.withColumn("score", F.col("__u") * (0.5 + 0.5 * (F.col("__h") if hot else F.lit(1.0)))).select(*df.columns, "score")


# -- stacks ------------------------------------------------------------------------


def stack(df: DataFrame, bands: list[str], sigmas: tuple[float, ...] = (1.0, 2.0), quantised: bool = True) -> DataFrame:
    """(r, c, features): for every band the band itself, slopes, ridges and valleys at each scale, its coherence and how its ridges line up.

    Names are band, band_slope_i, band_ridge_i, band_valley_i, band_coherence,
    band_chain. Scaled to the footprint, 0 outside; bytes 0 to 255 unless
    quantised is off. Each band is read, stencilled and written once.
    """
    out, names = df, list(bands)
    for b in bands:
        out = slopes(out, {f"{b}_slope_{i}": (b, s) for i, s in enumerate(sigmas)})
        out = lines(lines(out, b, sigmas, -1, f"{b}_ridge_"), b, sigmas, 1, f"{b}_valley_")
        out = S.structure(out, b, 1.0, 3.0).withColumn(f"{b}_coherence", 2 * F.col("coherence")).drop("coherence", "angle", "gx", "gy", "sxx", "syy", "sxy")
        out = settle(out, "stack")
        names += [f"{b}_{k}_{i}" for k in ("slope", "ridge", "valley") for i in range(len(sigmas))] + [f"{b}_coherence"]
    out = N.robust_units(out, {f"u_{k}": k for k in names}, _foot())
    for b in bands:
        out = S.occupancy(out.withColumn("__m", F.col(f"u_{b}_ridge_0") > 0.6), "__m", 5).withColumnRenamed("vote", f"u_{b}_chain").drop("__m")
    names += [f"{b}_chain" for b in bands]
    # rounded first, so that a last bit of a quantile moves no byte
    value = lambda k: F.floor(F.round(F.col(f"u_{k}"), 9) * 255).cast("short") if quantised else F.col(f"u_{k}").cast("float")
    return out.select("r", "c", *(F.when(_foot(), value(k)).otherwise(F.lit(0)).alias(k) for k in sorted(names)))


def cube(stacked: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(r, c, features): the columns in order of their names as one array; raises where a wanted one is missing or is no number."""
    there = {f.name: f.dataType.simpleString() for f in stacked.schema if f.name not in ("r", "c")}
    names = sorted(wanted or there)
    bad = [n for n in names if there.get(n) not in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    if bad:
        raise ValueError(f"no numbers in {bad}")
    return stacked.select("r", "c", F.array(*(F.col(n).cast("float") for n in names)).alias("features"))


def at_points(stacked: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """Only the named features of only the given cells: the scan reads those columns, the join keeps those rows."""
    return points.select("r", "c").join(stacked.select("r", "c", *names), ["r", "c"])


# -- candidates ----------------------------------------------------------------------


def power_product(channels: dict[str, float], floor: float = 1e-6) -> Column:
    """Product of channels to their powers, each no lower than floor; powers of 0 leave a channel out."""
    terms = [F.lit(float(w)) * F.log(F.greatest(F.col(c), F.lit(floor))) for c, w in channels.items() if w]
    return F.exp(sum(terms[1:], terms[0])) if terms else F.lit(1.0)


def candidates(df: DataFrame, recipes: dict[str, str | dict[str, float]]) -> DataFrame:
    """(r, c, name, value) of candidate fields: SQL expressions over the columns of df, or powers of them; one scan for all."""
    made = [F.struct(F.lit(n).alias("name"), (F.expr(x) if isinstance(x, str) else power_product(x)).cast("double").alias("value")) for n, x in recipes.items()]
    keep = [c for c in ("r", "c", "truth", "foot", "block") if c in df.columns]
    return df.select(*keep, F.explode(F.array(*made)).alias("__x")).select(*keep, "__x.name", "__x.value")
