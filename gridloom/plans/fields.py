"""Queries on scaling, ranks, stencils and detectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import normalise as N
from ..operators import stencil as S
from .base import d, filled, n6, query, r6, robust_sql, smooth_sql, sql, values_sql, view



@query(sql(f"SELECT r, c, {n6('u')} AS u FROM s", robust_sql("s", "lat", "px", "u")))
def robust_unit(spark, sf_dir):
    return N.robust_unit(view(spark, sf_dir), "px", "u", F.col("foot")).select("r", "c", r6("u").alias("u"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN px / (CASE WHEN q > 1e-12 THEN q ELSE m END + 1e-12) ELSE 0 END')} AS v FROM full_, (SELECT quantile_cont(px, 0.99999) AS q, max(abs(px)) AS m FROM full_ WHERE foot)"))
def tie_free_norm(spark, sf_dir):
    return N.tie_free(filled(spark, sf_dir), "px", "v", F.col("foot")).select("r", "c", r6("v").alias("v"))


@query(sql("SELECT r, c, floor(round(u, 9) * 255)::SMALLINT AS q FROM s", robust_sql("s", "lat", "px", "u")))
def quantize_u8(spark, sf_dir):
    u = N.robust_unit(view(spark, sf_dir), "px", "u", F.col("foot"))
    return u.select("r", "c", F.floor(F.round("u", 9) * 255).cast("short").alias("q"))


@query(sql(f"SELECT r, c, {n6('least(greatest(px, q0), q1)')} AS v FROM lat, (SELECT quantile_cont(px, 0.001) AS q0, quantile_cont(px, 0.999) AS q1 FROM lat WHERE foot) WHERE px IS NOT NULL"))
def percentile_clip(spark, sf_dir):
    return N.clip(view(spark, sf_dir).filter("px IS NOT NULL"), "px", "v", F.col("foot")).select("r", "c", r6("v").alias("v"))


@query(sql(f"SELECT r, c, {n6('(row_number() OVER (ORDER BY px, r, c) - 1) / greatest(count(*) OVER () - 1, 1)')} AS u FROM full_ WHERE foot"))
def rank_unit(spark, sf_dir):
    return N.rank_unit(filled(spark, sf_dir), "px", "u", F.col("foot")).select("r", "c", r6("u").alias("u"))


_RANK = "(row_number() OVER (ORDER BY {0}, r, c) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE"


@query(sql(f"SELECT r, c, {n6('4.0::DOUBLE / (2.0::DOUBLE / (a + 0.05::DOUBLE) + 1.0::DOUBLE / (b + 0.05::DOUBLE) + 1.0::DOUBLE / (t + 0.05::DOUBLE))')} AS score FROM (SELECT r, c, {_RANK.format('px')} AS a, {_RANK.format('disc')} AS b, {_RANK.format('tax')} AS t FROM full_ WHERE foot)"))
def harmonic_rank_fusion(spark, sf_dir):
    df = N.rank_units(filled(spark, sf_dir), {"a": "px", "b": "disc", "t": "tax"}, F.col("foot"))
    return df.select("r", "c", r6(N.harmonic_fusion({"a": 2.0, "b": 1.0, "t": 1.0})).alias("score"))


@query(sql(f"SELECT r, c, {n6('exp((1.3::DOUBLE * ln(greatest(u, 1e-6)) + 1.0::DOUBLE * ln(greatest(v, 1e-6))) / 2.3::DOUBLE)')} AS score FROM t", robust_sql("s", "full_", "px", "u"), robust_sql("t", "s", "tax", "v")))
def geometric_fusion(spark, sf_dir):
    df = N.robust_unit(N.robust_unit(filled(spark, sf_dir), "px", "u", F.col("foot")), "tax", "v", F.col("foot"))
    return df.select("r", "c", r6(N.geometric_fusion({"u": 1.3, "v": 1.0})).alias("score"))


@query(sql(f"SELECT r, c, {n6('(u + v + w) / 3')} AS score FROM x", robust_sql("s", "full_", "px", "u", 0.02, 0.98), robust_sql("t", "s", "tax", "v", 0.02, 0.98), robust_sql("x", "t", "disc", "w", 0.02, 0.98)))
def mean_of_scaled_bands(spark, sf_dir):
    df = filled(spark, sf_dir)
    for band, out in (("px", "u"), ("tax", "v"), ("disc", "w")):
        df = N.robust_unit(df, band, out, F.col("foot"), 0.02, 0.98)
    return df.select("r", "c", r6((F.col("u") + F.col("v") + F.col("w")) / 3).alias("score"))


@query(sql(f"SELECT r, c, {n6('g')} AS g FROM s", smooth_sql("s", "full_", {"g": ("px", 1.5, 0, 0)})))
def gaussian_smooth(spark, sf_dir):
    return S.smooth(filled(spark, sf_dir), {"g": ("px", 1.5, 0, 0)}).select("r", "c", r6("g").alias("g"))


_DIFF = "CASE WHEN lag(g) OVER w{0} IS NULL THEN lead(g) OVER w{0} - g WHEN lead(g) OVER w{0} IS NULL THEN g - lag(g) OVER w{0} ELSE (lead(g) OVER w{0} - lag(g) OVER w{0}) / 2 END"


@query(sql(f"SELECT r, c, {n6('sqrt(fr * fr + fc * fc)')} AS mag FROM (SELECT r, c, {_DIFF.format('d')} AS fr, {_DIFF.format('a')} AS fc FROM s WINDOW wd AS (PARTITION BY c ORDER BY r), wa AS (PARTITION BY r ORDER BY c))", smooth_sql("s", "full_", {"g": ("px", 1.0, 0, 0)})))
def gradient_magnitude(spark, sf_dir):
    df = S.finite_gradient(S.smooth(filled(spark, sf_dir), {"g": ("px", 1.0, 0, 0)}), "g")
    return df.select("r", "c", r6(F.sqrt(F.col("fr") * F.col("fr") + F.col("fc") * F.col("fc"))).alias("mag"))


def hessian_sql(name: str, source: str, band: str, sigma: float) -> str:
    return smooth_sql(f"{name}_h", source, {"hxx": (band, sigma, 0, 2), "hyy": (band, sigma, 2, 0), "hxy": (band, sigma, 1, 1)}) + f""",
{name}_e AS (SELECT * EXCLUDE (hxx, hyy, hxy), (hxx + hyy) / 2 + sqrt((hxx - hyy) * (hxx - hyy) / 4 + hxy * hxy) AS e1, (hxx + hyy) / 2 - sqrt((hxx - hyy) * (hxx - hyy) / 4 + hxy * hxy) AS e2 FROM {name}_h),
{name} AS (SELECT * EXCLUDE (e1, e2), e1 AS largest, CASE WHEN abs(e1) >= abs(e2) THEN e1 ELSE e2 END AS dom, CASE WHEN abs(e1) >= abs(e2) THEN e2 ELSE e1 END AS tan_ FROM {name}_e)"""


def line_sql(sign: int = -1) -> str:
    r = {-1: "greatest(-dom, 0)", 1: "greatest(dom, 0)", 0: "abs(dom)"}[sign]
    return f"{r} * pow(greatest(0, least(1, 1 - abs(tan_) / (abs(dom) + 1e-9))), 1.5)"


@query(sql(f"SELECT r, c, {n6(line_sql())} AS line, {n6('greatest(-largest, 0)')} AS ridge FROM h", hessian_sql("h", "full_", "px", 1.5)))
def hessian_line_response(spark, sf_dir):
    df = S.line_response(filled(spark, sf_dir), "px", 1.5)
    return df.select("r", "c", r6("line").alias("line"), r6(F.greatest(-F.col("largest"), F.lit(0.0))).alias("ridge"))


_TENSOR = [smooth_sql("g", "full_", {"gx": ("px", 1.0, 0, 1), "gy": ("px", 1.0, 1, 0)}), "j AS (SELECT *, gx * gx AS jxx, gy * gy AS jyy, gx * gy AS jxy FROM g)", smooth_sql("s", "j", {"sxx": ("jxx", 2.0, 0, 0), "syy": ("jyy", 2.0, 0, 0), "sxy": ("jxy", 2.0, 0, 0)})]


@query(sql(f"SELECT r, c, {n6('sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) / (sxx + syy + 1e-12)')} AS coherence, round(0.5 * atan2(2 * sxy, sxx - syy), 4) + 0.0::DOUBLE AS angle FROM s", *_TENSOR))
def structure_coherence(spark, sf_dir):
    df = S.structure(filled(spark, sf_dir), "px", 1.0, 2.0)
    return df.select("r", "c", r6("coherence").alias("coherence"), (F.round("angle", 4) + F.lit(0.0)).alias("angle"))


@query(sql("SELECT r, c, round(a - 180 * floor(a / 180), 4) + 0.0::DOUBLE AS strike FROM (SELECT r, c, degrees(atan2(gx, -gy)) + 90 AS a FROM g WHERE abs(gx) > 1e-6)", _TENSOR[0]))
def strike_axis(spark, sf_dir):
    df = S.gradient(filled(spark, sf_dir), "px", 1.0).filter(F.abs("gx") > 1e-6)
    return df.select("r", "c", (F.round(S.strike("gx", "gy"), 4) + F.lit(0.0)).alias("strike"))


def signal_sql(height: float) -> list[str]:
    import math

    cell = 100.0
    inner, outer = max(height / cell / math.sqrt(2), 0.5), max(height / cell, 0.8)
    return [
        smooth_sql("u", "full_", {"g": ("px", inner, 0, 0)}),
        f"f AS (SELECT *, {_DIFF.format('d')} AS fr, {_DIFF.format('a')} AS fc FROM u WINDOW wd AS (PARTITION BY c ORDER BY r), wa AS (PARTITION BY r ORDER BY c))",
        smooth_sql("z", "f", {"lxx": ("g", outer, 0, 2), "lyy": ("g", outer, 2, 0)}),
    ]


@query(sql(f"SELECT r, c, {n6('sqrt(fc / 100 * (fc / 100) + fr / 100 * (fr / 100) + (lxx + lyy) * 100 * ((lxx + lyy) * 100))')} AS signal FROM z", *signal_sql(200.0)))
def analytic_signal(spark, sf_dir):
    return S.analytic_signal(filled(spark, sf_dir), "px", 200.0).select("r", "c", r6("signal").alias("signal"))


@query(sql(f"""
SELECT r, c, {n6("greatest(x0, x1, x2, x3) / 9.0::DOUBLE")} AS vote FROM (
  SELECT r, c, sum(m) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x0, sum(m) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x1,
    sum(m) OVER (PARTITION BY r - c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x2, sum(m) OVER (PARTITION BY r + c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x3
  FROM (SELECT r, c, (cat OR dot)::INT AS m FROM lat))"""))
def oriented_occupancy(spark, sf_dir):
    df = view(spark, sf_dir).withColumn("m", F.col("cat") | F.col("dot"))
    return S.occupancy(df, "m").select("r", "c", r6("vote").alias("vote"))


@query(sql(f"SELECT r, c, {n6('min(b) OVER w')} AS lo, {n6('max(a) OVER w')} AS hi FROM (SELECT r, c, min(px) OVER w AS b, max(px) OVER w AS a FROM full_ WINDOW w AS (PARTITION BY c ORDER BY r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"))
def local_extrema(spark, sf_dir):
    return S.extrema(filled(spark, sf_dir), "px").select("r", "c", r6("lo").alias("lo"), r6("hi").alias("hi"))


def _open_sql() -> str:
    import math

    parts = []
    for dr, dc in [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]:
        parts += [f"({dr}, {dc}, {k}, {d(k * math.hypot(dr, dc))})" for k in (1, 2, 3)]
    return f"m(dr, dc, k, len) AS (VALUES {', '.join(parts)}),\nang AS (SELECT a.r, a.c, dr, dc, max(degrees(atan((b.px - a.px) / len))) AS x FROM full_ a, m JOIN full_ b ON b.r = a.r + dr * k AND b.c = a.c + dc * k GROUP BY ALL)"


@query(sql(f"SELECT r, c, {n6('90 - sum(x) / count(x)')} AS open FROM ang GROUP BY r, c", _open_sql()))
def openness(spark, sf_dir):
    return S.openness(filled(spark, sf_dir), "px").select("r", "c", r6("open").alias("open"))


_PLACES = [(k, i, j, w) for k in range(8) for i, j, w in S.bilinear(-3 * math.sin(math.pi * k / 4), 3 * math.cos(math.pi * k / 4))]


@query(sql(f"SELECT r, c, {n6('max(greatest(atan2(v - px, 3), 0)) - max(greatest(atan2(px - v, 3), 0))')} AS asym FROM s GROUP BY r, c", values_sql("way", "k, dr, dc, w", _PLACES),
           "s AS (SELECT a.r, a.c, a.px, k, sum(w * b.px) AS v FROM full_ a, way JOIN full_ b ON b.r = least(greatest(a.r + dr, 0), 357) AND b.c = least(greatest(a.c + dc, 0), 49) GROUP BY ALL)"))
def openness_asymmetry(spark, sf_dir):
    """Angles up less angles down at three cells, between cells bilinear."""
    return S.openness_asymmetry(filled(spark, sf_dir).select("r", "c", "px"), "px").select("r", "c", r6("asym").alias("asym"))


@query(sql(f"SELECT r, c, px, {n6('gp')} AS px_2, {n6('gd')} AS disc_1 FROM g WHERE dot", smooth_sql("g", "full_", {"gp": ("px", 2.0, 0, 0), "gd": ("disc", 1.0, 0, 0)})))
def lazy_features(spark, sf_dir):
    """Bands and their smooths at the dots only."""
    from ..operators.lazy import smoothed_at

    df = filled(spark, sf_dir)
    found = smoothed_at(df, df.filter("dot"), {"px": ("px", 0.0), "px_2": ("px", 2.0), "disc_1": ("disc", 1.0)})
    return found.select("r", "c", "px", r6("px_2").alias("px_2"), r6("disc_1").alias("disc_1"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN ws > 1e-9 THEN vs / ws WHEN wl > 1e-9 THEN vl / wl ELSE m END')} AS filled FROM s, (SELECT sum(px * w) / sum(CASE WHEN px IS NOT NULL THEN w END) AS m FROM p)",
           "p AS (SELECT *, CASE WHEN dot THEN n END::DOUBLE AS w FROM lat)", "q AS (SELECT *, coalesce(px * w, 0) AS v0, coalesce(w, 0) AS w0 FROM p)",
           smooth_sql("s", "q", {"vs": ("v0", 1.0, 0, 0), "ws": ("w0", 1.0, 0, 0), "vl": ("v0", 3.0, 0, 0), "wl": ("w0", 3.0, 0, 0)})))
def two_scale_idw(spark, sf_dir):
    df = view(spark, sf_dir).withColumn("w", F.when(F.col("dot"), F.col("n")).cast("double"))
    return S.two_scale(df, "px", "w", 1.0, 3.0).select("r", "c", r6("filled").alias("filled"))


# -- detectors --------------------------------------------------------------

_XG = smooth_sql("g", "full_", {f"{x}{b}": (b, 1.5, *o) for b in ("px", "tax") for x, o in (("gx_", (0, 1)), ("gy_", (1, 0)))})


@query(sql(f"""SELECT r, c, {n6('exp((ln(0.05 + e1 / (q1 + 1e-12)) + ln(0.05 + e2 / (q2 + 1e-12))) / 2) * pow(sqrt(cx * cx + cy * cy) / (e1 + e2 + 1e-12), 1.5)')} AS score FROM (
  SELECT *, e1 * (gx_px / (e1 + 1e-12) * (gx_px / (e1 + 1e-12)) - gy_px / (e1 + 1e-12) * (gy_px / (e1 + 1e-12))) + e2 * (gx_tax / (e2 + 1e-12) * (gx_tax / (e2 + 1e-12)) - gy_tax / (e2 + 1e-12) * (gy_tax / (e2 + 1e-12))) AS cx,
    e1 * 2 * (gx_px / (e1 + 1e-12)) * (gy_px / (e1 + 1e-12)) + e2 * 2 * (gx_tax / (e2 + 1e-12)) * (gy_tax / (e2 + 1e-12)) AS cy FROM e, (SELECT quantile_cont(e1, 0.99) AS q1, quantile_cont(e2, 0.99) AS q2 FROM e WHERE foot))""",
           _XG, "e AS (SELECT *, sqrt(gx_px * gx_px + gy_px * gy_px) AS e1, sqrt(gx_tax * gx_tax + gy_tax * gy_tax) AS e2 FROM g)"))
def cross_gradient(spark, sf_dir):
    return D.DETECTORS["cross_gradient"][2](filled(spark, sf_dir)).select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('sqrt(gx * gx + gy * gy) * exp(-0.5 * (px / (q + 1e-12)) * (px / (q + 1e-12)))')} AS score FROM g, (SELECT quantile_cont(abs(px), 0.9) AS q FROM g WHERE foot)", smooth_sql("g", "full_", {"gx": ("px", 1.0, 0, 1), "gy": ("px", 1.0, 1, 0)})))
def zero_crossing(spark, sf_dir):
    return D.zero_crossing(filled(spark, sf_dir), "px").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('ua * ub * ((ax * bx + ay * by_) / (ea * eb + 1e-12)) * ((ax * bx + ay * by_) / (ea * eb + 1e-12))')} AS score FROM y",
           smooth_sql("g", "full_", {"ax": ("px", 1.0, 0, 1), "ay": ("px", 1.0, 1, 0), "bx": ("tax", 1.0, 0, 1), "by_": ("tax", 1.0, 1, 0)}), "e AS (SELECT *, sqrt(ax * ax + ay * ay) AS ea, sqrt(bx * bx + by_ * by_) AS eb FROM g)",
           robust_sql("x", "e", "ea", "ua"), robust_sql("y", "x", "eb", "ub")))
def co_edge(spark, sf_dir):
    return D.co_edge(filled(spark, sf_dir), "px", "tax").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('ur * (0.55 + 0.25 * ua + 0.2 * ub)')} AS score FROM z", hessian_sql("h", "full_", "px", 1.5), f"l AS (SELECT *, {line_sql()} AS line FROM h)", robust_sql("x", "l", "line", "ur"), robust_sql("y", "x", "n", "ua"), robust_sql("z", "y", "disc", "ub")))
def ridge_incumbent(spark, sf_dir):
    return D.incumbent_ridge(filled(spark, sf_dir), "px", "n", "disc").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('0.5 * ua + 0.3 * ur + 0.2 * ud')} AS score FROM z", hessian_sql("h", "full_", "tax", 1.5), f"l AS (SELECT *, {line_sql(0)} AS line FROM h)",
           "v AS (SELECT *, min(disc) OVER w AS b, max(disc) OVER w AS a FROM l WINDOW w AS (PARTITION BY c ORDER BY r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))",
           "e AS (SELECT *, max(a) OVER w - min(b) OVER w AS span FROM v WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))",
           robust_sql("x", "e", "px", "ua"), robust_sql("y", "x", "line", "ur"), robust_sql("z", "y", "span", "ud")))
def strain_corridor(spark, sf_dir):
    return D.strain_corridor(filled(spark, sf_dir), "px", "tax", "disc").select("r", "c", r6("score").alias("score"))


def _signal_cte(name: str, source: str, height: float, out: str) -> str:
    u, f, z = (x.replace("full_", source).replace("u AS", f"{name}_u AS").replace("u_v", f"{name}_u_v").replace("FROM u ", f"FROM {name}_u ") for x in signal_sql(height))
    f = f.replace("f AS (", f"{name}_f AS (", 1)
    z = smooth_sql(f"{name}_z", f"{name}_f", {"lxx": ("g", max(height / 100.0, 0.8), 0, 2), "lyy": ("g", max(height / 100.0, 0.8), 2, 0)})
    return f"{u},\n{f},\n{z},\n{name} AS (SELECT * EXCLUDE (g, fr, fc, lxx, lyy), ln(1 + sqrt(fc / 100 * (fc / 100) + fr / 100 * (fr / 100) + (lxx + lyy) * 100 * ((lxx + lyy) * 100))) AS {out} FROM {name}_z)"


def _line_cte(name: str, source: str, band: str, sigma: float, sign: int, out: str) -> str:
    return hessian_sql(f"{name}_x", source, band, sigma) + f",\n{name} AS (SELECT * EXCLUDE (largest, dom, tan_), {line_sql(sign)} AS {out} FROM {name}_x)"


@query(sql(f"SELECT r, c, {n6('(u0 + u1) / 2')} AS score FROM h2", _signal_cte("a", "full_", 100.0, "s0"), _line_cte("b", "a", "s0", 1.5, -1, "l0"), robust_sql("h1", "b", "l0", "u0"), _signal_cte("e", "h1", 200.0, "s1"), _line_cte("f9", "e", "s1", 1.5, -1, "l1"), robust_sql("h2", "f9", "l1", "u1")))
def worm(spark, sf_dir):
    return D.worm(filled(spark, sf_dir), "px").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('2.0::DOUBLE / (1.0::DOUBLE / (a + 0.05::DOUBLE) + 1.0::DOUBLE / (b + 0.05::DOUBLE))')} AS score FROM (SELECT r, c, {_RANK.format('round(l1, 9)')} AS a, {_RANK.format('round(l2, 9)')} AS b FROM m WHERE foot)", hessian_sql("h", "full_", "px", 1.5), f"l AS (SELECT * EXCLUDE (largest, dom, tan_), {line_sql(0)} AS l1 FROM h)", hessian_sql("k", "l", "tax", 1.5), f"m AS (SELECT *, {line_sql(0)} AS l2 FROM k)"))
def backbone(spark, sf_dir):
    df = filled(spark, sf_dir)
    for band, out in (("px", "l1"), ("tax", "l2")):
        df = S.line_response(df, band, 1.5, 0).withColumn(out, F.round("line", 9)).drop("line", "dom", "tan", "largest")
    df = N.rank_units(df, {"l1r": "l1", "l2r": "l2"}, F.col("foot"))
    return df.select("r", "c", r6(N.harmonic_fusion({"l1r": 1.0, "l2r": 1.0})).alias("score"))


_RC = smooth_sql("g", "full_", {f"{x}{b}": (b, 1.0, *o) for b in ("px", "tax", "disc") for x, o in (("gx_", (0, 1)), ("gy_", (1, 0)))})


@query(sql(f"SELECT r, c, {n6('sqrt(ur * uc) * abs((bx * gx_disc + by_ * gy_disc) / (re * ce + 1e-12))')} AS score FROM y", _RC, "e AS (SELECT *, sqrt(gx_px * gx_px + gy_px * gy_px) AS e1, sqrt(gx_tax * gx_tax + gy_tax * gy_tax) AS e2, sqrt(gx_disc * gx_disc + gy_disc * gy_disc) AS ce FROM g)",
           "b AS (SELECT *, greatest(e1, e2) AS re, CASE WHEN e2 > e1 THEN gx_tax ELSE gx_px END AS bx, CASE WHEN e2 > e1 THEN gy_tax ELSE gy_px END AS by_ FROM e)", robust_sql("x", "b", "re", "ur"), robust_sql("y", "x", "ce", "uc")))
def radiometric_cosine(spark, sf_dir):
    return D.DETECTORS["radiometric_cosine"][2](filled(spark, sf_dir)).select("r", "c", r6("score").alias("score"))


@query("""
WITH o AS (SELECT o_custkey * 37 % 360 AS a, round(o_totalprice * 100)::BIGINT AS v FROM orders),
f AS (SELECT least(floor(least(a % 180, 180 - a % 180) / 2.5), 35)::INT AS bin, v FROM o),
b AS (SELECT bin, sum(v)::DOUBLE / count(*) AS v FROM f GROUP BY 1)
SELECT i::INT AS bin, round((i + 0.5) * 90.0 / 36, 6)::DOUBLE AS centre, round(coalesce(v, (SELECT avg(v) FROM b)), 4) AS value FROM range(36) t(i) LEFT JOIN b ON bin = i
""")
def binned_mean_curve(spark, sf_dir):
    from ..sources import lattice as L

    o = L.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 37 % 360).alias("a"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return D.favourability("a", "v", o).select("bin", r6("centre").alias("centre"), F.round("value", 4).alias("value"))


_GATE = "rel - 180 * floor(rel / 180)"


@query(sql(f"SELECT r, c, {n6('ue * (0.25 + 0.75 * least(2 * coh, 1)) * (0.3 + 0.7 * coalesce(value, 0.5))')} AS score FROM z LEFT JOIN curve ON curve.bin = z.bin",
           """o AS (SELECT o_custkey * 37 % 360 AS a, o_totalprice / 500000 AS v FROM orders), fb AS (SELECT least(floor(least(a % 180, 180 - a % 180) / 2.5), 35)::INT AS bin, avg(v) AS v FROM o GROUP BY 1),
curve AS (SELECT i::INT AS bin, coalesce(v, (SELECT avg(v) FROM fb)) AS value FROM range(36) t(i) LEFT JOIN fb ON bin = i)""",
           smooth_sql("g", "full_", {"gx": ("px", 1.5, 0, 1), "gy": ("px", 1.5, 1, 0)}), "j AS (SELECT *, gx * gx AS jxx, gy * gy AS jyy, gx * gy AS jxy FROM g)", smooth_sql("s", "j", {"sxx": ("jxx", 1.5, 0, 0), "syy": ("jyy", 1.5, 0, 0), "sxy": ("jxy", 1.5, 0, 0)}),
           "w AS (SELECT *, sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) / (sxx + syy + 1e-12) AS coh, sqrt(gx * gx + gy * gy) AS edge, degrees(atan2(gx, -gy)) + 90 - 120 AS rel FROM s)", robust_sql("y", "w", "edge", "ue"),
           f"z AS (SELECT *, least(floor(least({_GATE}, 180 - ({_GATE})) / 2.5), 35)::INT AS bin FROM y)"))
def stress_gate(spark, sf_dir):
    from ..sources import lattice as L

    o = L.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 37 % 360).alias("a"), (F.col("o_totalprice") / 500000).alias("v"))
    return D.stress_gate(filled(spark, sf_dir), "px", 30.0, D.favourability("a", "v", o)).select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN f - l ELSE 0 END')} AS score FROM s", "p AS (SELECT *, CASE WHEN foot AND px IS NOT NULL THEN px ELSE (SELECT avg(px) FROM lat WHERE foot) END AS f FROM lat)", smooth_sql("s", "p", {"l": ("f", 4.0, 0, 0)})))
def local_mean_residual(spark, sf_dir):
    return D.residual(view(spark, sf_dir), "px", 4.0).select("r", "c", r6("score").alias("score"))
