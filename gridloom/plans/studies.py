"""Queries on prices and budgets, locked evaluation, composite fields and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import cross_offsets, offsets
from ..operators import audit as A
from ..operators import budget as B
from ..operators import components as C
from ..operators import composites as K
from ..operators import decision as P
from ..operators import emission as E
from ..operators import evaluate as V
from ..operators import holdout as H
from ..operators import learners
from ..operators import stencil as S
from ..session import settle
from ..sources.lattice import HEIGHT, WIDTH
from .base import d, filled, n6, query, r6, robust_sql, smooth_sql, sql, values_sql, view
from .choices import _CURVE, _curve, _nations
from .fields import _DIFF, _line_cte, _signal_cte, hessian_sql
from .space import _BLOCK, _DTI, _LABEL, _NEAR, _dti_sql, _labelled

# -- prices and budgets ---------------------------------------------------------

_RATE = "q AS (SELECT rank, hit, avg(hit::INT) OVER (ORDER BY rank ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS rate, sum(hit::INT) OVER (ORDER BY rank)::DOUBLE AS cum FROM h)"


@query(sql(f"SELECT cut, {n6('(SELECT count(*) FILTER (hit) FROM q WHERE rank <= cut) / greatest(cut, 1)::DOUBLE')} AS mean_rate FROM (SELECT coalesce(min(rank - 1) FILTER (rank > 100 AND round(rate, 9) < 0.6), max(rank))::BIGINT AS cut FROM q)", *_CURVE, _RATE))
def first_crossing_budget(spark, sf_dir):
    """Where the hit rate around a rank first falls below a price."""
    out = B.first_crossing(_curve(spark, sf_dir), 0.6, 100, 50)
    return out.select("cut", r6("mean_rate").alias("mean_rate"))


_PRICED = f"""SELECT round, {n6('score_in')} AS score_in, {n6('price')} AS price, n, {n6('score_out')} AS score_out FROM walk WHERE round >= 0"""
_STEP = "(3 * exp(-3 * w.m / 900::DOUBLE) * (1 - 0.2 * w.score_out) + 0.2 * w.score_out * 0.5)"


@query(sql(_PRICED, *_CURVE, _RATE, f"""walk(round, score_in, price, n, m, score_out, done) AS (
  SELECT -1, 0::DOUBLE, 0::DOUBLE, NULL::BIGINT, 0::DOUBLE, 0.2778::DOUBLE, FALSE
  UNION ALL
  SELECT x.round, x.score_in, x.price, x.cut, q.cum, 900 * (1 - exp(-3 * q.cum / 900)) / (0.2 * (900 * (1 - exp(-3 * q.cum / 900))) + 0.2 * (x.cut - 0.5 * q.cum) + 0.8 * 900), coalesce(abs(x.cut - x.was) <= 5, FALSE)
  FROM (SELECT w.round + 1 AS round, w.score_out AS score_in, 0.2 * w.score_out / {_STEP} AS price, w.n AS was,
    (SELECT coalesce(min(rank - 1) FILTER (rank > 100 AND rate < 0.2 * w.score_out / {_STEP}), max(rank))::BIGINT FROM q) AS cut FROM walk w WHERE NOT w.done AND w.round < 11) x JOIN q ON q.rank = x.cut)""", recursive=True))  # fmt: skip
def priced_budget(spark, sf_dir):
    """The budget and its own price, round by round."""
    out = B.priced_budget(_curve(spark, sf_dir), 900.0, half=50, least=100, near=5)
    return out.select("round", r6("score_in").alias("score_in"), r6("price").alias("price"), "n", r6("score_out").alias("score_out"))


_RATES = "t AS (SELECT n_nationkey AS k, 10000 + 1000 * n_nationkey AS n, 0.02::DOUBLE + 0.004 * n_nationkey AS s, 14143::DOUBLE AS g FROM nation)"
_FWD = "(g * (1 - exp(-3 * ({0}) / g)) / (0.2 * (g * (1 - exp(-3 * ({0}) / g))) + 0.2 * (n - 0.5 * ({0})) + 0.8 * g))"


@query(f"""WITH RECURSIVE {_RATES},
b(k, n, s, g, lo, hi, i) AS (SELECT k, n, s, g, 0::DOUBLE, n::DOUBLE, 0 FROM t UNION ALL
  SELECT k, n, s, g, CASE WHEN {_FWD.format('(lo + hi) / 2')} < s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_FWD.format('(lo + hi) / 2')} < s THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 80)
SELECT k, n, {n6('(lo + hi) / 2 / n')} AS rate FROM b WHERE i = 80""")
def implied_hit_rate(spark, sf_dir):
    """The hit rate that the forward model needs for a score, by bisection, a row per nation."""
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), (10000 + 1000 * F.col("n_nationkey")).alias("n"), (F.lit(0.02) + 0.004 * F.col("n_nationkey")).alias("s"), F.lit(14143.0).alias("g"))
    return B.implied_rates(t, "n", "s", "g").select("k", "n", r6("rate").alias("rate"))


def _pairs(spark, sf_dir):
    """Scores of a set of points and of the same set pruned, from sizes that differ by nation."""
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), (40000.0 + 200 * F.col("n_nationkey")).alias("n_base"), (9000.0 + 400 * F.col("n_nationkey")).alias("size"))
    t = t.withColumns({"n_prune": F.col("n_base") * 0.94, "hits": F.col("n_base") * 0.06, "removed": F.lit(0.0), "l0": F.lit(3.0), "kb": F.lit(0.5)})
    tp = F.col("size") * (1 - F.exp(-3 * F.col("hits") / F.col("size")))
    score = lambda n: tp / (0.2 * tp + 0.2 * (F.col(n) - 0.5 * F.col("hits")) + 0.8 * F.col("size"))
    return t.select("k", "n_base", score("n_base").alias("s_base"), "n_prune", score("n_prune").alias("s_prune"), "removed", "l0", "kb")


@query("SELECT n_nationkey AS k, 9000 + 400 * n_nationkey AS g, round(0.06 * (40000 + 200 * n_nationkey), 2)::DOUBLE AS m, TRUE AS agrees FROM nation")
def nested_pair_solve(spark, sf_dir):
    """Truth size and hits from two scores: the sizes that the scores were made of come back."""
    s = B.solve_pairs(_pairs(spark, sf_dir))
    return s.select("k", F.round("g", 0).cast("int").alias("g"), F.round("m", 2).alias("m"), (F.col("residual") < 1e-9).alias("agrees"))


@query()
def nested_pair_sensitivity(spark, sf_dir):
    """The same under 20 assumptions a pair."""
    s = B.pair_sensitivity(_pairs(spark, sf_dir), [2.0, 2.5, 3.0, 3.65, 4.5], [0.4, 0.5, 0.6, 0.7])
    return s.select("k", "solved", *(F.round(x, 1).alias(x) for x in ("g_least", "g_median", "g_most")))


_GRID = [100, 300, 900, 2000]


@query(sql(f"SELECT budget, dots, {n6('sum(tp)')} AS tp, {n6('sum(fp)')} AS fp, {n6('sum(fn)')} AS fn, {n6('sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-12)')} AS dti, {n6('sum(tp) / dots')} AS credit FROM parts_all JOIN (SELECT budget, count(*) AS dots FROM taken GROUP BY 1) USING (budget) GROUP BY budget, dots",
           f"src AS (SELECT *, {_BLOCK()} AS block FROM lat WHERE NOT cat)",
           "dots AS (SELECT r, c, row_number() OVER (ORDER BY score DESC, r, c) AS rank FROM lat WHERE dot)", "grid_ AS (SELECT unnest([100, 300, 900, 2000])::BIGINT AS budget)",
           "taken AS (SELECT r, c, budget FROM dots, grid_ WHERE rank <= budget)", "counted AS (SELECT s.r, s.c, s.block, s.truth, g.budget, t.r IS NOT NULL AS hit FROM src s CROSS JOIN grid_ g LEFT JOIN taken t ON t.r = s.r AND t.c = s.c AND t.budget = g.budget)",
           _dti_sql("w", "truth", "block")[0],
           "given AS (SELECT budget, block, r + dr AS r, c + dc AS c, max(k) AS v FROM counted, credit WHERE hit GROUP BY ALL)", "seen AS (SELECT budget, block, r + dr AS r, c + dc AS c, max(k) AS v FROM counted, credit WHERE truth GROUP BY ALL)",
           "parts_all AS (SELECT c.budget, c.block, sum(CASE WHEN truth THEN coalesce(g.v, 0) ELSE 0 END) AS tp, sum(CASE WHEN hit THEN 1 - coalesce(s.v, 0) ELSE 0 END) AS fp, count(*) FILTER (truth) - sum(CASE WHEN truth THEN coalesce(g.v, 0) ELSE 0 END) AS fn FROM counted c LEFT JOIN given g ON g.budget = c.budget AND g.block = c.block AND g.r = c.r AND g.c = c.c LEFT JOIN seen s ON s.budget = c.budget AND s.block = c.block AND s.r = c.r AND s.c = c.c GROUP BY 1, 2)"))
def marginal_credit(spark, sf_dir):
    """What each budget of the best dots earns over the folds."""
    df = view(spark, sf_dir).withColumn("block", H.uniform_block(HEIGHT, WIDTH, 4, 2))
    dots = E.number(df.filter("dot").select("r", "c", "score"))
    out = B.marginal_credit(dots.select("r", "c", "rank"), df.filter("NOT cat").select("r", "c", "block", "truth"), "truth", "block", _GRID)
    return out.select("budget", "dots", *(r6(x).alias(x) for x in ("tp", "fp", "fn", "dti", "credit")))


@query()
def leave_one_out(spark, sf_dir):
    """The saturating score, each artifact predicted from the others."""
    t = _nations(spark, sf_dir).select("k", (1000.0 + 900 * F.col("k")).alias("n"), (0.1 + 0.004 * (F.col("z") % 7)).alias("w"))
    tp = 5800 * (1 - F.exp(-1.17 * F.col("n") * F.col("w") / 5800))
    t = t.withColumn("score", tp / (0.2 * tp + 0.2 * F.col("n") + 0.8 * 5800))
    return B.leave_one_out(t, "k").select(F.col("key").alias("k"), F.round("k", 0).alias("size"), F.round("a", 2).alias("a"), F.round("error", 4).alias("error"))


# -- statistics ------------------------------------------------------------------


@query(sql(f"SELECT block, cells, truths, {n6('coalesce(s / nullif(truths, 0), 0.5)')} AS lift FROM (SELECT block, sum(n)::BIGINT AS cells, sum(t)::BIGINT AS truths, sum(t * below / all_::DOUBLE) AS s FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY block ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER (PARTITION BY block) AS all_ FROM (SELECT {_BLOCK()} AS block, score, count(*) AS n, count(*) FILTER (truth) AS t FROM lat WHERE foot GROUP BY 1, 2)) GROUP BY 1)"))
def left_rank_lift(spark, sf_dir):
    df = view(spark, sf_dir).filter("foot").withColumn("block", H.uniform_block(HEIGHT, WIDTH, 4, 2))
    return P.left_rank_lift(df, "score", "truth", "block").select("block", "cells", "truths", r6("lift").alias("lift"))


@query(sql(" UNION ALL ".join(f"SELECT '{b}' AS band, {n6(f'max({b})::DOUBLE')} AS most, (SELECT count(*) FROM full_ WHERE foot AND {b} >= (SELECT max({b}) FROM full_ WHERE foot)) AS at_most, (SELECT count(*) FROM full_ WHERE foot AND round({b}, 9) >= (SELECT round(quantile_cont({b}, 0.995), 9) FROM full_ WHERE foot)) AS at_high FROM full_ WHERE foot" for b in ("n", "px", "disc", "tax", "score"))))
def tie_diagnostic(spark, sf_dir):
    """How many cells sit at the top of each band: emission breaks such ties by place."""
    bands = ["n", "px", "disc", "tax", "score"]
    df = filled(spark, sf_dir).withColumns({b: F.round(F.col(b), 9) for b in bands})
    return P.ties_at_top(df, bands, F.col("foot")).select("band", r6("most").alias("most"), "at_most", "at_high")


_ALGEBRA = {"product": "u * v", "root": "sqrt(u * v)", "lifted": "u * (0.3D + 0.7D * v)", "inverse": "1D - u"}
_POWERS = {"half": {"u": 1.0, "v": 0.5}, "squared": {"u": 2.0}}


@query(sql(f"""SELECT name, {n6('sum(mid * t) / sum(t)')} AS lift FROM (SELECT name, (2 * sum(n) OVER (PARTITION BY name ORDER BY value) - n) / 2.0::DOUBLE / sum(n) OVER (PARTITION BY name) AS mid, t FROM (
  SELECT name, round(value, 9) AS value, count(*) AS n, count(*) FILTER (truth) AS t FROM (
    SELECT truth, unnest(['product', 'root', 'lifted', 'inverse', 'half', 'squared']) AS name, unnest([u * v, sqrt(u * v), u * (0.3::DOUBLE + 0.7::DOUBLE * v), 1 - u, greatest(u, 1e-6) * pow(greatest(v, 1e-6), 0.5), pow(greatest(u, 1e-6), 2)]) AS value FROM y WHERE foot) GROUP BY 1, 2)) GROUP BY name""",
           robust_sql("x", "full_", "px", "u"), robust_sql("y", "x", "tax", "v")))
def candidate_algebra(spark, sf_dir):
    """Products, roots and powers of two scaled bands, each measured by its rank lift."""
    from ..operators.normalise import robust_units

    df = robust_units(filled(spark, sf_dir), {"u": "px", "v": "tax"}, F.col("foot")).filter("foot")
    long = settle(K.candidates(df, _ALGEBRA | _POWERS).withColumn("value", F.round("value", 9)), "candidates")
    lifts = P.lift_by(long, "value", "truth", "name")
    return lifts.select("name", r6("lift").alias("lift"))


# -- locked evaluation -------------------------------------------------------------

_LOCK = 3  # erosion and collar that fit a lattice of 50 columns
_LOCKED = f"""box AS (SELECT min(r) AS r0, max(r) + 1 AS r1, min(c) AS c0, max(c) + 1 AS c1 FROM lat WHERE foot),
cut AS (SELECT i, floor(r0 + i * (r1 - r0) / 4.0)::INT AS er, floor(c0 + i * (c1 - c0) / 4.0)::INT AS ec FROM box, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
cellof AS (SELECT a.i AS gr, b.i AS gc, a.er AS r0, a2.er AS r1, b.ec AS c0, b2.ec AS c1, (a.i // 2) * 2 + b.i // 2 AS ordinal FROM cut a JOIN cut a2 ON a2.i = a.i + 1, cut b JOIN cut b2 ON b2.i = b.i + 1 WHERE a.i % 2 = 0 AND b.i % 2 = 0),
outp AS (SELECT r, c FROM lat WHERE NOT foot),
{_NEAR("outn", "outp", _LOCK)},
locked AS (SELECT l.r, l.c, ordinal::INT AS ordinal, foot AND o.d IS NULL AND least(l.r - r0 + 1, r1 - l.r, l.c - c0 + 1, c1 - l.c) > {_LOCK} AS active FROM lat l JOIN cellof ON l.r >= r0 AND l.r < r1 AND l.c >= c0 AND l.c < c1 LEFT JOIN outn o ON o.r = l.r AND o.c = l.c)"""


def _locked(spark, sf_dir):
    return V.locked_cells(view(spark, sf_dir).select("r", "c", "foot"), F.col("foot"), 4, _LOCK)


@query(sql("SELECT r, c, ordinal, active FROM locked", _LOCKED))
def locked_cells(spark, sf_dir):
    return _locked(spark, sf_dir)


_HIDDEN = f"boxes AS (SELECT ordinal, min(r) - {_LOCK} AS r0, max(r) + {_LOCK} AS r1, min(c) - {_LOCK} AS c0, max(c) + {_LOCK} AS c1 FROM locked GROUP BY 1),\nhidden AS (SELECT DISTINCT ordinal, comp FROM comps JOIN boxes ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)"


@query(sql("SELECT ordinal, comp FROM hidden", _LABEL, _LOCKED, _HIDDEN, recursive=True))
def locked_hidden_components(spark, sf_dir):
    return V.hidden_components(_labelled(spark, sf_dir), _locked(spark, sf_dir), _LOCK)


@query(sql("SELECT r, c, EXISTS (SELECT 1 FROM comps x WHERE x.r = l.r AND x.c = l.c AND x.comp NOT IN (SELECT comp FROM hidden WHERE ordinal = 1)) AS known, NOT (r BETWEEN (SELECT r0 FROM boxes WHERE ordinal = 1) AND (SELECT r1 FROM boxes WHERE ordinal = 1) AND c BETWEEN (SELECT c0 FROM boxes WHERE ordinal = 1) AND (SELECT c1 FROM boxes WHERE ordinal = 1)) AND NOT EXISTS (SELECT 1 FROM comps x JOIN hidden h ON h.comp = x.comp AND h.ordinal = 1 WHERE x.r = l.r AND x.c = l.c) AS train FROM lat l", _LABEL, _LOCKED, _HIDDEN, recursive=True))
def locked_fold_view(spark, sf_dir):
    """What the second locked cell's model may see."""
    lab, locked = settle(_labelled(spark, sf_dir)), settle(_locked(spark, sf_dir))
    return V.fold_view(view(spark, sf_dir).select("r", "c"), lab, locked, V.hidden_components(lab, locked, _LOCK), 1, _LOCK)


@query()
def paired_tile_scores(spark, sf_dir):
    """Two fields emitted to the same budget in each locked cell, and scored alike."""
    df = view(spark, sf_dir).withColumn("alt", F.lit(1.0) - F.col("score"))
    cells = settle(_locked(spark, sf_dir).join(df.select("r", "c", "score", "alt", "truth", "cat"), ["r", "c"]))
    out = V.paired_scores(cells, ("score", "alt"), "truth", "cat", V.budgets(cells, 1000, HEIGHT * WIDTH))
    return out.select("ordinal", "budget", "dots_a", "dots_b", "truth_a", *(r6(x).alias(x) for x in ("dti_a", "dti_b")), "win")


_DIAG = f"src AS (SELECT *, dot::INT::DOUBLE AS w, {_BLOCK()} AS block FROM lat WHERE NOT cat)"
_AROUND3 = values_sql("three", "dr, dc, d", [(i, j, float(x)) for i, j, x in offsets(3)])
_COVER = ["cov AS (SELECT block, count(*) AS truth_covered FROM (SELECT DISTINCT t.block, t.r, t.c FROM src t, three JOIN src p ON p.r = t.r + dr AND p.c = t.c + dc AND p.block = t.block AND p.dot WHERE t.truth) GROUP BY 1)", "hitd AS (SELECT block, count(*) AS hits FROM (SELECT DISTINCT p.block, p.r, p.c FROM src p, three JOIN src t ON t.r = p.r + dr AND t.c = p.c + dc AND t.block = p.block AND t.truth WHERE p.dot) GROUP BY 1)"]


@query(sql(f"SELECT block, n_truth, n_pred, {n6(_DTI)} AS dti, coalesce(truth_covered, 0) AS truth_covered, coalesce(hits, 0) AS hits, {n6('coalesce(truth_covered, 0) / greatest(n_truth, 1)')} AS coverage, {n6('coalesce(hits, 0) / greatest(n_pred, 1)')} AS hit_rate FROM parts LEFT JOIN cov USING (block) LEFT JOIN hitd USING (block)", _DIAG, *_dti_sql("w", "truth", "block"), _AROUND3, *_COVER))
def fold_diagnostics(spark, sf_dir):
    """Index, coverage of truth and hit rate of dots per fold."""
    df = view(spark, sf_dir).filter("NOT cat").withColumns({"w": F.col("dot").cast("double"), "block": H.uniform_block(HEIGHT, WIDTH, 4, 2)})
    out = V.diagnostics(df, "w", "truth", ("block",))
    return out.select("block", "n_truth", "n_pred", r6("dti").alias("dti"), "truth_covered", "hits", r6("coverage").alias("coverage"), r6("hit_rate").alias("hit_rate"))


def _two(name: str, truth: str, known: str) -> str:
    src = f"src AS (SELECT r, c, dot, ({truth}) AS truth, dot::INT::DOUBLE AS w, {_BLOCK()} AS block FROM lat WHERE NOT ({known}))"
    whole = [x.replace("parts AS", "pooled AS").replace("given", "given0").replace("seen", "seen0").replace("hit AS", "hit0 AS").replace("miss AS", "miss0 AS").replace("FROM hit", "FROM hit0").replace(", miss", ", miss0").replace("p AS", "p0 AS", 1).replace("FROM p,", "FROM p0,").replace("FROM p t", "FROM p0 t") for x in _dti_sql("w", "truth")[1:] if not x.startswith("t AS")]
    return sql(f"""SELECT '{name}' AS instrument, (SELECT count(*) FROM parts) AS folds, (SELECT {n6('avg(' + _DTI + ')')} FROM parts) AS mean_dti, n_truth AS pooled_n_truth, n_pred AS pooled_n_pred, {n6('tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12)')} AS pooled_dti,
  (SELECT count(*) FROM (SELECT DISTINCT t.r, t.c FROM src t, three JOIN src p ON p.r = t.r + dr AND p.c = t.c + dc AND p.dot WHERE t.truth)) AS truth_covered,
  (SELECT count(*) FROM (SELECT DISTINCT p.r, p.c FROM src p, three JOIN src t ON t.r = p.r + dr AND t.c = p.c + dc AND t.truth WHERE p.dot)) AS hits FROM pooled""", src, *_dti_sql("w", "truth", "block"), *whole, _AROUND3)  # fmt: skip


@query(f"SELECT * FROM ({_two('I1', 'truth', 'cat')}) UNION ALL SELECT * FROM ({_two('I2', 'okey % 31 = 0 AND foot', 'cat OR off')})")
def two_instruments(spark, sf_dir):
    """One prediction against two truths, each with its own known cells."""
    df = view(spark, sf_dir).withColumns({"w": F.col("dot").cast("double"), "block": H.uniform_block(HEIGHT, WIDTH, 4, 2), "other": F.coalesce(F.col("okey") % 31 == 0, F.lit(False)) & F.col("foot")})
    out = V.two_instruments(df, "w", {"I1": ("truth", F.col("cat")), "I2": ("other", F.col("cat") | F.col("off"))}, "block")
    return out.select("instrument", "folds", r6("mean_dti").alias("mean_dti"), "pooled_n_truth", "pooled_n_pred", r6("pooled_dti").alias("pooled_dti"), "truth_covered", "hits")


_STATS = "st AS (SELECT comp, count(*) AS size, floor(avg(r))::INT AS r, floor(avg(c))::INT AS c FROM comps GROUP BY 1)"
_HOLD = [_LABEL, _STATS, f"bb AS (SELECT *, {_BLOCK()} AS block FROM st)", "hid AS (SELECT comp FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY block ORDER BY md5('11:' || comp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY block) AS total FROM bb) WHERE before < total * 0.25::DOUBLE)",
         values_sql("two", "dr, dc", cross_offsets(2)), values_sql("one", "dr, dc", cross_offsets(1)), "knownc AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM comps, two WHERE comp NOT IN (SELECT comp FROM hid))", "rimc AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM lat, one WHERE NOT foot)"]


@query(sql(f"""SELECT {_BLOCK()} AS block, count(*) FILTER (a) AS active, count(*) FILTER (a AND t) AS truth, count(*) FILTER (k) AS known FROM (
  SELECT l.r, l.c, k.r IS NOT NULL AS k, foot AND k.r IS NULL AND m.r IS NULL AS a, h.r IS NOT NULL AS t FROM lat l LEFT JOIN knownc k ON k.r = l.r AND k.c = l.c LEFT JOIN rimc m ON m.r = l.r AND m.c = l.c LEFT JOIN (SELECT r, c FROM comps WHERE comp IN (SELECT comp FROM hid)) h ON h.r = l.r AND h.c = l.c) GROUP BY 1""", *_HOLD, recursive=True))  # fmt: skip
def component_holdout(spark, sf_dir):
    """A holdout of whole components: active, truth and known cells of each block."""
    df = view(spark, sf_dir)
    out = V.holdout(df.select("r", "c", "foot", "okey"), F.col("foot"), F.col("okey") % 3 == 0, H.uniform_block(HEIGHT, WIDTH, 4, 2), 0.25, 11, 2, 1)
    return out.groupBy("block").agg(F.count(F.when(F.col("active"), 1)).alias("active"), F.count(F.when(F.col("truth"), 1)).alias("truth"), F.count(F.when(F.col("known"), 1)).alias("known"))


_CUT = lambda n, k: [int(n * i / k) for i in range(k + 1)]
_BOXES = [(i * 2 + j, _CUT(HEIGHT, 4)[i], _CUT(HEIGHT, 4)[i + 1] - 1, _CUT(WIDTH, 2)[j], _CUT(WIDTH, 2)[j + 1] - 1) for i in range(4) for j in range(2)]
_INNER = "r BETWEEN r0 + 3 AND r1 - 3 AND c BETWEEN c0 + 3 AND c1 - 3"


@query(sql("""SELECT 'I1' AS instrument, s.seed, v.block, v.r, v.c, h.comp IS NOT NULL AS truth FROM live v, seeds s LEFT JOIN hid3 h ON h.seed = s.seed AND h.block = v.block AND h.comp = v.comp WHERE v.comp IS NULL OR h.comp IS NOT NULL
  UNION ALL SELECT 'I2', seed, block, r, c, coalesce(okey % 31 = 0, FALSE) FROM live, seeds WHERE comp IS NULL""", _LABEL, values_sql("boxes", "block, r0, r1, c0, c1", _BOXES), values_sql("seeds", "seed", [(31,), (32,)]),
    f"nearb AS (SELECT block, comp, greatest(r0 - r, r - r1, 0) + greatest(c0 - c, c - c1, 0) AS steps, {_INNER} AS inside FROM comps, boxes)",
    "cand AS (SELECT block, comp FROM nearb GROUP BY 1, 2 HAVING bool_or(steps = 0) AND NOT bool_or(steps <= 4 AND NOT inside))",
    "sized AS (SELECT seed, block, cand.comp, n AS size FROM cand JOIN (SELECT comp, count(*) AS n FROM comps GROUP BY 1) z ON z.comp = cand.comp, seeds)",
    "hid3 AS (SELECT seed, block, comp FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY seed, block ORDER BY md5(seed || ':' || block || ':' || comp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY seed, block) AS total FROM sized) WHERE before < total * 0.25::DOUBLE)",
    f"live AS (SELECT lat.r, lat.c, okey, block, comp FROM lat JOIN boxes ON {_INNER.replace('r B', 'lat.r B').replace(' c B', ' lat.c B')} LEFT JOIN comps ON comps.r = lat.r AND comps.c = lat.c WHERE foot)", recursive=True))
def annulus_holdout(spark, sf_dir):
    """Every active cell of every fold of both instruments, with its truth."""
    df = view(spark, sf_dir).select("r", "c", "foot", "okey")
    labelled = settle(C.components(df.filter("foot AND okey % 3 = 0")))
    out = H.annulus_holdout(df.filter("foot"), labelled, F.col("okey") % 31 == 0, HEIGHT, WIDTH, 4, 2, erode=3, collar=4)
    return out.select("instrument", "seed", "block", "r", "c", "truth")


@query(sql("SELECT l.r, l.c, coalesce(s.d BETWEEN 1 AND 6, FALSE) AND NOT truth AS hard, g.r IS NULL AND NOT truth AS background FROM lat l LEFT JOIN s ON s.r = l.r AND s.c = l.c LEFT JOIN (SELECT DISTINCT r + dr AS r, c + dc AS c FROM p, six) g ON g.r = l.r AND g.c = l.c WHERE foot", "p AS (SELECT r, c FROM lat WHERE truth)", _NEAR("s", "p", 6), values_sql("six", "dr, dc", cross_offsets(6))))
def negative_pools(spark, sf_dir):
    df = view(spark, sf_dir).select("r", "c", "foot", "truth")
    return V.negative_pools(df, F.col("truth")).filter("foot").select("r", "c", "hard", "background")


@query()
def discriminant_cells(spark, sf_dir):
    """Every cell's chance, by trees that saw nothing of its block."""
    df = filled(spark, sf_dir).filter("foot").withColumn("half", H.uniform_block(HEIGHT, WIDTH, 2, 1))
    return learners.discriminant(df.select("r", "c", "n", "px", "disc", "tax", "truth", "half"), ["n", "px", "disc", "tax"], F.col("truth"), "half", 2, least=10).select("r", "c", "block", "label", "prob")


@query()
def locked_comparator(spark, sf_dir):
    """(r, c, ordinal, prob) of all locked cells, by trees fitted outside of each."""
    df, lab, locked = filled(spark, sf_dir), settle(_labelled(spark, sf_dir)), settle(_locked(spark, sf_dir))
    return learners.locked_comparator(df.select("r", "c", "foot", "n", "px", "disc", "tax"), ["n", "px", "disc", "tax"], lab, locked, V.hidden_components(lab, locked, _LOCK), [r[0] for r in locked.select("ordinal").distinct().sort("ordinal").collect()], _LOCK)


@query(sql(f"""SELECT a.name, count(*) AS n, count(*) FILTER (s.d = 0) AS on_known, count(*) FILTER (s.d <= 2) AS within_2, count(*) FILTER (s.d <= 3) AS within_3, {n6('avg(s.d)')} AS mean_distance, {n6('quantile_cont(w.own, 0.5)')} AS median_spacing
  FROM a LEFT JOIN s ON s.r = a.r AND s.c = a.c LEFT JOIN w ON w.name = a.name AND w.r = a.r AND w.c = a.c GROUP BY a.name""", "a AS (SELECT okey % 5 AS name, r, c FROM lat WHERE dot)", "p AS (SELECT r, c FROM lat WHERE cat)", _NEAR("s", "p", 8),
           values_sql("eight", "dr, dc, d", [(i, j, float(x)) for i, j, x in offsets(8) if x > 0]), "w AS (SELECT x.name, x.r, x.c, min(d) AS own FROM a x, eight JOIN a y ON y.name = x.name AND y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2, 3)"))
def artifact_forensics(spark, sf_dir):
    """Where the dots of five artifacts lie."""
    df = view(spark, sf_dir)
    out = A.forensics(df.filter("dot").select("r", "c", (F.col("okey") % 5).alias("name")), df.filter("cat"), "name")
    return out.select("name", "n", "on_known", "within_2", "within_3", r6("mean_distance").alias("mean_distance"), r6("median_spacing").alias("median_spacing"))


# -- composite fields ----------------------------------------------------------------


def _slope_cte(name: str, source: str, jobs: dict[str, tuple[str, float]]) -> str:
    pairs = {f"{x}_{o}": (b, s, *k) for o, (b, s) in jobs.items() for x, k in (("x", (0, 1)), ("y", (1, 0)))}
    return smooth_sql(f"{name}_g", source, pairs) + f",\n{name} AS (SELECT * EXCLUDE ({', '.join(pairs)}), {', '.join(f'sqrt(x_{o} * x_{o} + y_{o} * y_{o}) AS {o}' for o in jobs)} FROM {name}_g)"


def _coherence_cte(name: str, source: str, band: str, sigma: float, wide: float, out: str) -> str:
    return smooth_sql(f"{name}_g", source, {"gx": (band, sigma, 0, 1), "gy": (band, sigma, 1, 0)}) + f",\n{name}_j AS (SELECT * EXCLUDE (gx, gy), gx * gx AS jxx, gy * gy AS jyy, gx * gy AS jxy FROM {name}_g),\n" + smooth_sql(f"{name}_s", f"{name}_j", {"sxx": ("jxx", wide, 0, 0), "syy": ("jyy", wide, 0, 0), "sxy": ("jxy", wide, 0, 0)}) + f",\n{name} AS (SELECT * EXCLUDE (jxx, jyy, jxy, sxx, syy, sxy), 2 * (sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) / (sxx + syy + 1e-12)) AS {out} FROM {name}_s)"


def _vote_cte(name: str, source: str, mask: str, half: int, out: str) -> str:
    frame = f"RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    return f"{name}_m AS (SELECT *, ({mask})::INT AS m FROM {source}),\n{name} AS (SELECT * EXCLUDE (m), greatest(sum(m) OVER (PARTITION BY r ORDER BY c {frame}), sum(m) OVER (PARTITION BY c ORDER BY r {frame}), sum(m) OVER (PARTITION BY r - c ORDER BY r {frame}), sum(m) OVER (PARTITION BY r + c ORDER BY r {frame})) / {2 * half + 1}.0::DOUBLE AS {out} FROM {name}_m)"


@query(sql(f"SELECT r, c, {n6('score')} AS score FROM z", _slope_cte("a", "(SELECT *, 0.5 * (tax + disc) AS ab FROM full_)", {"t0": ("px", 1.0), "t1": ("px", 2.0), "t2": ("px", 3.0), "g": ("ab", 1.5)}),
           robust_sql("b", "a", "t0", "u0"), robust_sql("e", "b", "t1", "u1"), robust_sql("f", "e", "t2", "u2"), robust_sql("k", "f", "g", "ug"), "y AS (SELECT r, c, foot, (u0 + u1 + u2) / 3 * (0.5 + 0.5 * ug) AS v FROM k)", robust_sql("z", "y", "v", "score")))
def tilt_edge(spark, sf_dir):
    return K.tilt_edge(filled(spark, sf_dir), "px", "tax", "disc").select("r", "c", r6("score").alias("score"))


def _break_cte(name: str, source: str, band: str, sigma: float, out: str) -> str:
    return smooth_sql(f"{name}_q", source, {"g": (band, sigma, 0, 0)}) + f",\n{name}_d AS (SELECT *, {_DIFF.format('d')} AS fr_, {_DIFF.format('a')} AS fc_ FROM {name}_q WINDOW wd AS (PARTITION BY c ORDER BY r), wa AS (PARTITION BY r ORDER BY c)),\n{name} AS (SELECT * EXCLUDE (g, fr_, fc_), sqrt(fr_ * fr_ + fc_ * fc_) AS {out} FROM {name}_d)"


@query(sql(f"SELECT r, c, {n6('score')} AS score FROM z", _line_cte("a", "full_", "px", 1.5, -1, "l0"), _line_cte("b", "a", "px", 3.0, -1, "l1"), _break_cte("e", "b", "tax", 1.5, "b0"), _break_cte("f", "e", "tax", 3.0, "b1"),
           robust_sql("g1", "f", "l0", "ul0"), robust_sql("g2", "g1", "l1", "ul1"), robust_sql("g3", "g2", "b0", "ub0"), robust_sql("g4", "g3", "b1", "ub1"), robust_sql("g5", "g4", "disc", "us"), _vote_cte("h1", "g5", "ul0 > 0.03", 3, "v0"), _vote_cte("h2", "h1", "ul1 > 0.03", 3, "v1"),
           "y AS (SELECT r, c, foot, ((0.5 * ul0 + 0.5 * ub0) * (0.4 + 0.6 * v0) + (0.5 * ul1 + 0.5 * ub1) * (0.4 + 0.6 * v1)) / 2 * (0.6 + 0.8 * us) AS v FROM h2)", robust_sql("z", "y", "v", "score")))
def stepover(spark, sf_dir):
    return K.stepover(filled(spark, sf_dir), "px", "tax", "disc").select("r", "c", r6("score").alias("score"))


def _kink_cte(name: str, source: str, band: str, sigma: float, i: int) -> str:
    return smooth_sql(f"{name}_s", source, {"sm": (band, sigma, 0, 0)}) + ",\n" + hessian_sql(f"{name}_h", f"{name}_s", "sm", sigma) + f",\n{name} AS (SELECT * EXCLUDE (sm, largest, dom, tan_), abs(dom) AS d{i}, abs(dom) / (abs(dom) + abs(tan_) + 1e-12) AS k{i} FROM {name}_h)"


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN v / (CASE WHEN q > 1e-12 THEN q ELSE m END + 1e-12) ELSE 0 END')} AS score FROM y, (SELECT quantile_cont(v, 0.99999) AS q, max(abs(v)) AS m FROM y WHERE foot)",
           _kink_cte("a", "full_", "px", 2.0, 0), _kink_cte("b", "a", "px", 4.0, 1), _coherence_cte("e", "(SELECT *, ln(1 + greatest(n, 0)) AS ev FROM b)", "ev", 3.0, 3.0, "coh"), "e0 AS (SELECT *, -disc AS near_ FROM e)",
           robust_sql("f1", "e0", "d0", "ud0"), robust_sql("f2", "f1", "d1", "ud1"), robust_sql("f3", "f2", "n", "ue"), robust_sql("f4", "f3", "tax", "ul"), robust_sql("f5", "f4", "score", "us"), robust_sql("f6", "f5", "near_", "up"),
           "g AS (SELECT *, k0 * ud0 AS q0_, k1 * ud1 AS q1_, coh * ue AS ln_ FROM f6)", robust_sql("h1", "g", "q0_", "uq0"), robust_sql("h2", "h1", "q1_", "uq1"), robust_sql("h3", "h2", "ln_", "uln"),
           "y AS (SELECT *, (0.45 * (uq0 + uq1) / 2 + 0.35 * uln + 0.2 * ul) * (0.5 + 0.5 * up) * (0.7 + 0.3 * us) AS v FROM h3)"))
def strain_kink(spark, sf_dir):
    df = filled(spark, sf_dir).withColumnRenamed("score", "shear")
    return K.strain_kink(df, "px", "shear", "tax", "n", "disc", (2.0, 4.0)).select("r", "c", r6("score").alias("score"))


def _ridge_cte(name: str, source: str, band: str, sigma: float, out: str) -> str:
    return hessian_sql(f"{name}_x", source, band, sigma) + f",\n{name} AS (SELECT * EXCLUDE (largest, dom, tan_), greatest(-largest, 0) AS {out} FROM {name}_x)"


_STRUCT = ["r0", "r1", "r2", "c0", "c1", "m0", "m1", "m2", "m3"]


@query(sql(f"SELECT r, c, {n6('score')} AS score FROM z", _ridge_cte("a", "full_", "px", 1.5, "r0"), _ridge_cte("b", "a", "px", 3.0, "r1"), _ridge_cte("e", "b", "n", 2.0, "r2"), _coherence_cte("f", "e", "px", 1.0, 3.0, "c0"), _coherence_cte("g", "f", "tax", 1.5, 4.0, "c1"),
           _slope_cte("h", "g", {"m0": ("disc", 1.5), "m1": ("tax", 1.5), "m2": ("n", 1.5), "m3": ("score", 1.5)}), *(robust_sql(f"u{i}", f"u{i - 1}" if i else "h", k, f"u_{k}") for i, k in enumerate(_STRUCT)),
           "y AS (SELECT r, c, foot, pow(((u_r0 + u_r1) / 2 * (0.6 + 0.4 * u_c0) + 1e-3) * ((u_m0 + u_m1) / 2 * (0.6 + 0.4 * u_c1) + 1e-3) * ((u_m2 + u_m3) / 2 * (0.6 + 0.4 * u_r2) + 1e-3), 1 / 3::DOUBLE) AS v FROM u8)", robust_sql("z", "y", "v", "score")))
def structural_field(spark, sf_dir):
    df = filled(spark, sf_dir).withColumnRenamed("score", "shear")
    return K.structural(df, "px", ("disc", "tax"), ("n", "shear"), "n").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN u * (0.5 + 0.5 * h) ELSE 0 END')} AS score FROM x2", "p AS (SELECT *, CASE WHEN foot AND px IS NOT NULL THEN px ELSE (SELECT avg(px) FROM lat WHERE foot) END AS f FROM lat)", smooth_sql("s", "p", {"l": ("f", 4.0, 0, 0)}), "x0 AS (SELECT * EXCLUDE (tax), coalesce(tax, 0)::DOUBLE AS tax, greatest(CASE WHEN foot THEN f - l ELSE 0 END, 0) AS x FROM s)", robust_sql("x1", "x0", "x", "u"), robust_sql("x2", "x1", "tax", "h")))
def thermal_anomaly(spark, sf_dir):
    """What a band holds above its local mean, lifted by a second one."""
    df = view(spark, sf_dir).withColumn("tax", F.coalesce(F.col("tax").cast("double"), F.lit(0.0)))
    return K.thermal(df, "px", 4.0, "tax").select("r", "c", r6("score").alias("score"))


@query(sql(f"SELECT r, c, {n6('(w0 + w1) / 2')} AS worm, {n6('s1 - s0')} AS persist FROM h2", _signal_cte("a", "full_", 0.0, "s0"), _signal_cte("e", "a", 250.0, "s1"), _line_cte("b", "e", "s0", 1.0, -1, "l0"), _line_cte("f9", "b", "s1", 1.0, -1, "l1"), robust_sql("h1", "f9", "l0", "w0"), robust_sql("h2", "h1", "l1", "w1")))
def worm_persistence(spark, sf_dir):
    """Ridges of the analytic signal over heights, and what of the signal stays at the last one."""
    return K.worm_persistence(filled(spark, sf_dir), "px", (0.0, 250.0), (1.0,)).select("r", "c", r6("worm").alias("worm"), r6("persist").alias("persist"))


_FUSED = [("px", 1.0), ("px", 2.0), ("tax", 1.0), ("tax", 2.0)]


@query(sql(f"SELECT r, c, {n6('sqrt((sx - sy) * (sx - sy) + 4 * sc * sc) / (sx + sy + 1e-12)')} AS coherence, round(cos(radians(2 * (degrees(atan2(2 * sc, sx - sy)) / 2))), 4) + 0.0::DOUBLE AS turn FROM z",
           smooth_sql("g", "full_", {f"{x}{n}": (b, s, *o) for n, (b, s) in enumerate(_FUSED) for x, o in (("x", (0, 1)), ("y", (1, 0)))}), "m AS (SELECT " + ", ".join(f"avg(x{n} * x{n} + y{n} * y{n}) AS m{n}" for n in range(4)) + " FROM g)",
           "k AS (SELECT r, c, " + ", ".join(" + ".join(f"{a}{n} * {b}{n} / (m{n} + 1e-12)" for n in range(4)) + f" AS {o}" for a, b, o in (("x", "x", "xx"), ("y", "y", "yy"), ("x", "y", "xy"))) + " FROM g, m)",
           smooth_sql("z", "k", {"sx": ("xx", 3.0, 0, 0), "sy": ("yy", 3.0, 0, 0), "sc": ("xy", 3.0, 0, 0)})))
def fused_strike(spark, sf_dir):
    """The direction that several bands at several scales have in common; turn is the cosine of twice its azimuth."""
    out = S.fused_strike(filled(spark, sf_dir).select("r", "c", "px", "tax"), ["px", "tax"], (1.0, 2.0))
    return out.select("r", "c", r6("coherence").alias("coherence"), (F.round(F.cos(F.radians(2 * F.col("strike"))), 4) + F.lit(0.0)).alias("turn"))


@query()
def tip_corridor(spark, sf_dir):
    """Corridors ahead of the ends of the catalogue's traces, clear of the catalogue."""
    return K.tip_corridor(view(spark, sf_dir), F.col("cat")).select("r", "c", r6("value").alias("value"))


_STACK = ["px", "px_chain", "px_coherence", "px_ridge_0", "px_slope_0", "px_valley_0"]


@query(sql("SELECT r, c, " + ", ".join(f"(CASE WHEN foot THEN floor(round({k}, 9) * 255) ELSE 0 END)::SMALLINT AS {n}" for k, n in (("u_px", "px"), ("ch", "px_chain"), ("u_co", "px_coherence"), ("u_ri", "px_ridge_0"), ("u_sl", "px_slope_0"), ("u_va", "px_valley_0"))) + " FROM v",
           _slope_cte("a", "full_", {"sl": ("px", 1.0)}), _line_cte("b", "a", "px", 1.0, -1, "ri"), _line_cte("e", "b", "px", 1.0, 1, "va"), _coherence_cte("f", "e", "px", 1.0, 3.0, "co"),
           robust_sql("g1", "f", "px", "u_px"), robust_sql("g2", "g1", "sl", "u_sl"), robust_sql("g3", "g2", "ri", "u_ri"), robust_sql("g4", "g3", "va", "u_va"), robust_sql("g5", "g4", "co", "u_co"), _vote_cte("v", "g5", "u_ri > 0.6", 5, "ch")))
def feature_stack(spark, sf_dir):
    """Derived features of one band as bytes, in order of their names."""
    df = filled(spark, sf_dir).select("r", "c", "foot", "px")
    return K.stack(df, ["px"], (1.0,)).select("r", "c", *_STACK)


@query(sql("SELECT r, c, px, n, disc FROM full_ WHERE dot"))
def features_at_points(spark, sf_dir):
    """Only the named features of only the dots."""
    df = filled(spark, sf_dir)
    return K.at_points(df, df.filter("dot"), ["px", "n", "disc"])


@query(sql("SELECT r, c, round(disc::FLOAT::DOUBLE + 10 * n::FLOAT::DOUBLE + 100 * tax::FLOAT::DOUBLE, 3) AS checked FROM full_"))
def feature_cube(spark, sf_dir):
    """Bands as one array in order of their names."""
    df = filled(spark, sf_dir).select("r", "c", *(F.col(b).cast("double").alias(b) for b in ("tax", "n", "disc")))
    f = F.col("features")
    return K.cube(df).select("r", "c", F.round(f[0].cast("double") + 10 * f[1].cast("double") + 100 * f[2].cast("double"), 3).alias("checked"))
