"""Queries on distances, components, holdouts, emission and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import credit_offsets, cross_offsets, offsets
from ..operators import components as C
from ..operators import corridor as K
from ..operators import distance as T
from ..operators import emission as E
from ..operators import holdout as H
from ..operators import metric as M
from ..sources.lattice import HEIGHT, WIDTH
from .base import n6, query, r6, sql, values_sql, view

_NEAR = lambda name, points, radius: values_sql(f"{name}_o", "dr, dc, d", [(i, j, float(x)) for i, j, x in offsets(radius)]) + f",\n{name} AS (SELECT (p.r + dr)::INT AS r, (p.c + dc)::INT AS c, min(d) AS d FROM {points} p, {name}_o GROUP BY 1, 2)"
_CREDIT = values_sql("credit", "dr, dc, k", [(i, j, float(k)) for i, j, k in credit_offsets()])


# the nearest marked cell by rows of the mask: a cell sees one row of it at a time
_EDT = """m AS (SELECT r, c FROM lat WHERE {mask}),
g AS (SELECT l.r, l.c, min(abs(m.r - l.r)) AS gap FROM lat l JOIN m ON m.c = l.c GROUP BY 1, 2),
e AS (SELECT l.r, l.c, min((g.c - l.c) * (g.c - l.c) + gap * gap)::BIGINT AS d2 FROM lat l JOIN g ON g.r = l.r GROUP BY 1, 2)"""


@query(sql("SELECT r, c, d2 FROM e", _EDT.format(mask="dot")))
def distance_to_mask(spark, sf_dir):
    return T.distance(view(spark, sf_dir).select("r", "c", "dot"), F.col("dot")).select("r", "c", "d2")


# the nearest cell with a value: the nearest row in each column, then the best column, least row and column first
NEAREST = """m AS (SELECT r, c, px FROM lat WHERE {has}),
up AS (SELECT l.r, l.c, m.r AS n, row_number() OVER (PARTITION BY l.r, l.c ORDER BY abs(m.r - l.r), m.r) AS k FROM lat l JOIN m ON m.c = l.c),
col_ AS (SELECT r, c, n FROM up WHERE k = 1),
fillq AS (SELECT l.r, l.c, arg_min(struct_pack(fr := g.n, fc := g.c), ((g.c - l.c) * (g.c - l.c) + (g.n - l.r) * (g.n - l.r))::BIGINT * 100000000 + g.n * 10000 + g.c) AS s FROM lat l JOIN col_ g ON g.r = l.r GROUP BY 1, 2)"""


@query(sql(f"SELECT f.r, f.c, {n6('m.px')} AS px FROM fillq f JOIN m ON m.r = f.s.fr AND m.c = f.s.fc", NEAREST.format(has="dot AND px IS NOT NULL")))
def nearest_fill(spark, sf_dir):
    df = view(spark, sf_dir).select("r", "c", F.when(F.col("dot"), F.col("px")).alias("px"))
    return T.nearest_fill(df, "px", "v").select("r", "c", r6("v").alias("px"))


_CROSS = values_sql("o", "dr, dc", cross_offsets(3))


@query(sql("SELECT DISTINCT (r + dr)::INT AS r, (c + dc)::INT AS c FROM lat, o WHERE cat", _CROSS))
def dilate_cross(spark, sf_dir):
    return T.dilate(view(spark, sf_dir).filter(F.col("cat")), 3)


@query(sql("SELECT (r + dr)::INT AS r, (c + dc)::INT AS c FROM lat, o WHERE foot GROUP BY 1, 2 HAVING count(*) = 25", _CROSS))
def erode_cross(spark, sf_dir):
    return T.erode(view(spark, sf_dir), "foot", 3)


@query(sql("SELECT l.r, l.c FROM lat l ANTI JOIN b ON l.r = b.r AND l.c = b.c WHERE foot", "p AS (SELECT r, c FROM lat WHERE cat)", _NEAR("b", "p", 2)))
def buffer_exclusion(spark, sf_dir):
    df = view(spark, sf_dir)
    return T.beyond(df.filter(F.col("foot")), df.filter(F.col("cat")), 2).select("r", "c")


@query(sql("SELECT l.r, l.c, round(d, 6) AS dist FROM lat l JOIN b ON l.r = b.r AND l.c = b.c WHERE foot AND d >= 1", "p AS (SELECT r, c FROM lat WHERE cat)", _NEAR("b", "p", 6)))
def hard_negative_ring(spark, sf_dir):
    df = view(spark, sf_dir)
    ring = T.near(df.filter(F.col("cat")), 6).filter("d >= 1")
    return df.filter(F.col("foot")).join(ring, ["r", "c"]).select("r", "c", F.round("d", 6).alias("dist"))


_EDGES = [0.5, 1.5, 2.5, 4.5, 8.5, 16.5]
_BIN = " + ".join(f"(sqrt(d2) > {e})::INT" for e in _EDGES)
_PROFILE = f"b AS (SELECT {_BIN} AS bin, count(*) AS area, count(*) FILTER (truth) AS hits, (count(*) FILTER (truth))::DOUBLE / count(*) AS density FROM lat JOIN e USING (r, c) WHERE foot GROUP BY 1)"
_REL = "rel AS (SELECT *, area >= 200 AND density > 0 AS usable, density / (SELECT quantile_cont(density, 0.5) FROM b WHERE area >= 200 AND density > 0) AS rel FROM b)"


def _profile(df):
    edt = T.distance(df, F.col("cat"))
    return edt, T.profile(edt.filter(F.col("foot")), "truth", "d2", _EDGES, 200)


@query(sql(f"SELECT bin, area, hits, {n6('rel')} AS rel, usable FROM rel", _EDT.format(mask="cat"), _PROFILE, _REL))
def density_profile(spark, sf_dir):
    return _profile(view(spark, sf_dir))[1].select("bin", "area", "hits", r6("rel").alias("rel"), "usable")


@query(sql(f"SELECT l.r, l.c, {n6('CASE WHEN usable THEN least(greatest(rel, 0.15), 2) ELSE 0 END')} AS weight FROM lat l JOIN e USING (r, c) JOIN rel ON rel.bin = {_BIN} WHERE foot", _EDT.format(mask="cat"), _PROFILE, _REL))
def profile_weights(spark, sf_dir):
    edt, prof = _profile(view(spark, sf_dir))
    band = sum((F.when(F.sqrt("d2") > e, 1).otherwise(0) for e in _EDGES[1:]), F.when(F.sqrt("d2") > _EDGES[0], 1).otherwise(0))
    joined = edt.filter(F.col("foot")).withColumn("bin", band).join(prof.select("bin", "rel", "usable"), "bin")
    return joined.select("r", "c", r6(F.when(F.col("usable"), F.least(F.greatest("rel", F.lit(0.15)), F.lit(2.0))).otherwise(0.0)).alias("weight"))


# -- components ---------------------------------------------------------------

_MASK = "(okey % 3 = 0) AND foot"
_LABEL = f"""p AS (SELECT r, c, r * 50 + c AS id FROM lat WHERE {_MASK}),
runs AS (SELECT r, min(c) AS c0, max(c) AS c1, min(id) AS run FROM (SELECT *, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM p) GROUP BY r, g),
links AS (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON abs(b.r - a.r) = 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
reach(a, b) AS (SELECT run, run FROM runs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
label AS (SELECT a AS run, min(b) AS first FROM reach GROUP BY 1),
comps AS (SELECT p.r, p.c, (dense_rank() OVER (ORDER BY first))::INT AS comp FROM p JOIN runs ON runs.r = p.r AND p.c BETWEEN c0 AND c1 JOIN label USING (run))"""


def _labelled(spark, sf_dir):
    return C.components(view(spark, sf_dir).filter((F.col("okey") % 3 == 0) & F.col("foot")))


@query(sql("SELECT r, c, comp FROM comps", _LABEL, recursive=True))
def connected_components(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(sql(f"SELECT comp, count(*) AS size, {n6('avg(r)')} AS mean_r, {n6('avg(c)')} AS mean_c, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM comps GROUP BY 1", _LABEL, recursive=True))
def component_stats(spark, sf_dir):
    return C.stats(_labelled(spark, sf_dir)).withColumns({"mean_r": r6("mean_r"), "mean_c": r6("mean_c")})


@query(sql("""SELECT a.r, a.c, a.comp, s.size FROM comps a JOIN (SELECT comp, count(*) AS size FROM comps GROUP BY 1) s USING (comp)
WHERE s.size >= 5 AND (SELECT count(*) FROM comps b WHERE abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1) = 2""", _LABEL, recursive=True))  # fmt: skip
def component_tips(spark, sf_dir):
    return C.tips(_labelled(spark, sf_dir), 5)


_BLOCK = lambda r="r", c="c": "((" + " + ".join(f"({r} >= {int(HEIGHT * i / 4)})::INT" for i in (1, 2, 3)) + f") * 2 + ({c} >= {WIDTH // 2})::INT)"


@query(sql(f"SELECT {_BLOCK()} AS block, count(*) AS cells, count(*) FILTER (foot) AS inside FROM lat GROUP BY 1"))
def uniform_blocks(spark, sf_dir):
    df = view(spark, sf_dir).withColumn("block", H.uniform_block(HEIGHT, WIDTH, 4, 2))
    return df.groupBy("block").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("foot"), 1)).alias("inside"))


@query(sql("SELECT ((r >= q[1])::INT + (r >= q[2])::INT) * 2 + (c >= w)::INT AS block, count(*) AS cells FROM lat, (SELECT quantile_cont(r, [1/3::DOUBLE, 2/3::DOUBLE]) AS q, quantile_cont(c, 0.5) AS w FROM lat WHERE dot) GROUP BY 1"))
def quantile_blocks(spark, sf_dir):
    return H.quantile_block(view(spark, sf_dir), F.col("dot"), 3, 2).groupBy("block").agg(F.count(F.lit(1)).alias("cells"))


_STATS = "st AS (SELECT comp, count(*) AS size, floor(avg(r))::INT AS r, floor(avg(c))::INT AS c FROM comps GROUP BY 1)"


@query(sql("SELECT comp, block, size FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY block ORDER BY md5('11:' || comp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY block) AS total FROM b) WHERE before < total * 0.25::DOUBLE",
           _LABEL, _STATS, f"b AS (SELECT *, {_BLOCK()} AS block FROM st)", recursive=True))
def hide_components(spark, sf_dir):
    return H.hide(_labelled(spark, sf_dir), H.uniform_block(HEIGHT, WIDTH, 4, 2), 0.25, 11)


@query(sql("SELECT comp, size FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY md5('7:' || comp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st WHERE size >= 6) WHERE before < 800", _LABEL, _STATS, recursive=True))
def prevalence_match(spark, sf_dir):
    return H.prevalence_match(_labelled(spark, sf_dir), 800, 7)


@query(sql(f"SELECT outer_, count(DISTINCT inner_) AS folds, count(DISTINCT inner_) = 1 AS aligned FROM (SELECT (r >= 179)::INT AS inner_, {_BLOCK()} AS outer_ FROM lat) GROUP BY 1"))
def fold_alignment_audit(spark, sf_dir):
    df = view(spark, sf_dir).select(H.uniform_block(HEIGHT, WIDTH, 4, 2).alias("outer_"), H.uniform_block(HEIGHT, WIDTH, 2, 1).alias("inner_"))
    return H.alignment(df, "outer_", "inner_")


# -- emission -----------------------------------------------------------------


def _allowed(df):
    return T.beyond(df.filter(F.col("foot")), df.filter(F.col("cat")), 2)


@query()
def poisson_emit(spark, sf_dir):
    return E.emit(_allowed(view(spark, sf_dir)), "score", 2.8).withColumn("score", r6("score"))


@query()
def emit_prefix_budget(spark, sf_dir):
    """A budget of points from a pool of the best cells."""
    return E.emit_budget(_allowed(view(spark, sf_dir)), "score", 200, 2.8, exact=True).select("rank", "r", "c")


@query(sql("SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))::DOUBLE AS d2 FROM p a LEFT JOIN p b ON abs(a.r - b.r) <= 8 AND abs(a.c - b.c) <= 8 AND (a.r <> b.r OR a.c <> b.c) AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 64 GROUP BY 1, 2", "p AS (SELECT r, c FROM lat WHERE dot)"))
def spacing_knn2(spark, sf_dir):
    return E.spacing_knn(view(spark, sf_dir).filter(F.col("dot")).select("r", "c"), 8).select("r", "c", "d2")


@query()
def greedy_maxcover(spark, sf_dir):
    inside = view(spark, sf_dir).filter("foot").select("r", "c", "score")
    return E.max_cover(inside, "score", 50).withColumn("gain", r6("gain"))


# -- metrics --------------------------------------------------------------------


def _dti_sql(pred: str, truth: str, by: str = "") -> list[str]:
    keys, eq = (f"{by}, ", f"AND g.{by} = t.{by}") if by else ("", "")
    tp_eq = eq.replace("g.", "g.")
    return [
        _CREDIT,
        f"p AS (SELECT {keys}r, c, {pred} AS p FROM src WHERE {pred} > 0)",
        f"t AS (SELECT {keys}r, c FROM src WHERE {truth})",
        f"given AS (SELECT {keys}r + dr AS r, c + dc AS c, max(p * k) AS v FROM p, credit GROUP BY ALL)",
        f"seen AS (SELECT {keys}r + dr AS r, c + dc AS c, max(k) AS v FROM t, credit GROUP BY ALL)",
        f"hit AS (SELECT {'t.' + by + ', ' if by else ''}coalesce(sum(v), 0) AS tp, count(*) AS n_truth FROM t LEFT JOIN given g ON g.r = t.r AND g.c = t.c {tp_eq} {'GROUP BY ALL' if by else ''})",
        f"miss AS (SELECT {'t.' + by + ', ' if by else ''}coalesce(sum(p * (1 - coalesce(v, 0))), 0) AS fp, count(*) AS n_pred FROM p t LEFT JOIN seen g ON g.r = t.r AND g.c = t.c {eq} {'GROUP BY ALL' if by else ''})",
        f"parts AS (SELECT {by + ', ' if by else ''}coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n_truth, 0) AS n_truth, coalesce(n_pred, 0) AS n_pred, coalesce(n_truth, 0) - coalesce(tp, 0) AS fn FROM hit {f'FULL JOIN miss USING ({by})' if by else ', miss'})",
    ]


_DTI = "CASE WHEN n_truth > 0 THEN tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12) ELSE 0 END"
_COLS = f"{n6('tp')} AS tp, {n6('fp')} AS fp, {n6('fn')} AS fn, n_truth, n_pred, {n6(_DTI)} AS dti"
_SRC = f"src AS (SELECT *, dot::INT::DOUBLE AS w, {_BLOCK()} AS block FROM lat WHERE NOT cat)"


def _rounded(df, *keys):
    return df.select(*keys, *(r6(x).alias(x) for x in ("tp", "fp", "fn")), "n_truth", "n_pred", r6("dti").alias("dti"))


def _source(spark, sf_dir):
    return view(spark, sf_dir).withColumns({"w": F.col("dot").cast("int").cast("double"), "block": H.uniform_block(HEIGHT, WIDTH, 4, 2)}).filter(~F.col("cat"))


@query(sql(f"SELECT {_COLS} FROM parts", _SRC, *_dti_sql("w", "truth")))
def dti_binary(spark, sf_dir):
    return _rounded(M.parts(_source(spark, sf_dir), "w", "truth"))


@query(sql(f"SELECT {_COLS} FROM parts", _SRC, *_dti_sql("score", "truth")))
def dti_soft(spark, sf_dir):
    return _rounded(M.parts(_source(spark, sf_dir), "score", "truth"))


@query(sql(f"SELECT block, {_COLS} FROM parts", _SRC, *_dti_sql("w", "truth", "block")))
def fold_dti(spark, sf_dir):
    return _rounded(M.parts(_source(spark, sf_dir), "w", "truth", by=("block",)), "block")


@query(sql(f"SELECT {n6('sum(tp)')} AS tp, {n6('sum(fp)')} AS fp, {n6('sum(fn)')} AS fn, count(*) AS folds, {n6('sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-12)')} AS dti FROM parts", _SRC, *_dti_sql("w", "truth", "block")))
def pooled_dti(spark, sf_dir):
    p = M.pooled(M.parts(_source(spark, sf_dir), "w", "truth", by=("block",)))
    return p.select(*(r6(x).alias(x) for x in ("tp", "fp", "fn")), "folds", r6("dti").alias("dti"))


@query(sql(f"SELECT block, {n6('(a.tp - b.tp) * (1 - 0.2 * 0.3) - 0.2 * 0.3 * (a.fp - b.fp)')} AS delta FROM parts a JOIN parts2 b USING (block)", _SRC, *_dti_sql("score", "truth", "block"),
           *(s.replace("p AS", "p2 AS", 1).replace("given AS", "given2 AS").replace("seen AS", "seen2 AS").replace("hit AS", "hit2 AS").replace("miss AS", "miss2 AS").replace("parts AS", "parts2 AS").replace("FROM p,", "FROM p2,").replace("FROM p t", "FROM p2 t").replace("JOIN given", "JOIN given2").replace("JOIN seen", "JOIN seen2").replace("FROM hit", "FROM hit2").replace("JOIN miss", "JOIN miss2") for s in _dti_sql("w", "truth", "block")[1:] if not s.startswith("t AS"))))
def fold_score_delta(spark, sf_dir):
    src = _source(spark, sf_dir)
    delta = M.fold_delta(M.parts(src, "score", "truth", by=("block",)), M.parts(src, "w", "truth", by=("block",)), "block", F.lit(0.3))
    return delta.select("block", r6("delta").alias("delta"))


@query(sql(f"SELECT {n6('avg(coalesce(k, 0))')} AS w, count(*) AS n FROM lat l LEFT JOIN (SELECT r + dr AS r, c + dc AS c, max(k) AS k FROM lat, credit WHERE truth GROUP BY 1, 2) s ON s.r = l.r AND s.c = l.c WHERE dot", _CREDIT))
def expected_credit(spark, sf_dir):
    df = view(spark, sf_dir)
    return M.credit(df.filter(F.col("dot")).select("r", "c"), df.filter(F.col("truth"))).select(r6("w").alias("w"), "n")


@query(sql(f"SELECT count(*) FILTER (truth) AS shared, count(*) AS n, {n6('count(*) FILTER (truth) / count(*)')} AS leakage FROM lat WHERE dot"))
def leakage_probe(spark, sf_dir):
    df = view(spark, sf_dir)
    return M.leakage(df.filter(F.col("dot")).select("r", "c"), df.filter(F.col("truth"))).withColumn("leakage", r6("leakage"))


@query(sql("SELECT l.r, l.c, s.d IS NOT NULL AS hit FROM lat l LEFT JOIN s ON s.r = l.r AND s.c = l.c WHERE dot", "p AS (SELECT r, c FROM lat WHERE truth)", _NEAR("s", "p", 3)))
def dot_hits(spark, sf_dir):
    df = view(spark, sf_dir)
    return M.hits(df.filter(F.col("dot")).select("r", "c"), df.filter(F.col("truth"))).select("r", "c", "hit")


@query(sql("SELECT l.r, l.c, truth AND h.comp IS NOT NULL AS t FROM lat l LEFT JOIN (SELECT r, c, comp FROM comps JOIN (SELECT comp FROM st WHERE size >= 4) USING (comp)) h ON h.r = l.r AND h.c = l.c WHERE dot", _LABEL, _STATS, recursive=True))
def membership_join(spark, sf_dir):
    """Cells joined to the components of at least four cells that they lie in."""
    df, lab = view(spark, sf_dir), _labelled(spark, sf_dir)
    big = lab.join(C.stats(lab).filter("size >= 4").select("comp"), "comp", "left_semi").select("r", "c", F.lit(True).alias("in_"))
    return df.filter(F.col("dot")).join(big, ["r", "c"], "left").select("r", "c", (F.col("truth") & F.col("in_").isNotNull()).alias("t"))


@query()
def greedy_spacing_stats(spark, sf_dir):
    """Median spacing of an emission: never below the distance it was asked for."""
    dots = E.emit(_allowed(view(spark, sf_dir)), "score", 2.8)
    return E.spacing_knn(dots, 8).agg(F.count(F.lit(1)).alias("n"), F.min("d2").alias("least_d2"), r6(F.expr("percentile(sqrt(d2), 0.5)")).alias("median"))


@query(sql(f"SELECT r, c, {n6('max(w * f)')} AS value FROM (SELECT y + dr AS r, x + dc AS c, w, f FROM line, disc) GROUP BY 1, 2",
           "line AS (SELECT round_even(r - k * cos(radians(30 * (r % 6))), 0)::INT AS y, round_even(c + k * sin(radians(30 * (r % 6))), 0)::INT AS x, max(1 - abs(k) / 61::DOUBLE) AS w FROM lat, (SELECT unnest(range(-60, 61)) AS k) WHERE truth GROUP BY 1, 2)",
           values_sql("disc", "dr, dc, f", [(i, j, float(1 - x / 4)) for i, j, x in offsets(3)])))
def corridor_paint(spark, sf_dir):
    ends = view(spark, sf_dir).filter("truth").select("r", "c")
    return K.corridors(ends, (30 * (F.col("r") % 6)).cast("double"), 60, 3.0).withColumn("value", r6("value"))


@query()
def tip_strike(spark, sf_dir):
    """Strikes at the ends of the catalogue's traces: east-west, as the traces are."""
    traces = C.components(view(spark, sf_dir).filter(F.col("cat")))
    return K.tip_strikes(traces).select("r", "c", "comp", r6("strike").alias("strike"))


@query()
def thin_mask(spark, sf_dir):
    return K.thin(T.dilate(view(spark, sf_dir).filter(F.col("cat") & (F.col("c") % 9 != 0)), 2))
