"""Queries on curves, budgets, tests, correlations, set comparisons, learners and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import decision as P
from ..operators import distance as T
from ..operators import holdout as H
from ..operators import learners, metric
from ..sources import lattice as L
from ..sources.lattice import HEIGHT, WIDTH
from .base import SQL, d, filled, n6, query, r6, smooth_sql, sql, view
from .space import _NEAR, _allowed


_CURVE = ["p AS (SELECT r, c FROM lat WHERE truth)", _NEAR("s", "p", 3), "h AS (SELECT row_number() OVER (ORDER BY score DESC, l.r, l.c) AS rank, s.d IS NOT NULL AS hit FROM lat l LEFT JOIN s ON s.r = l.r AND s.c = l.c WHERE dot)"]


def _curve(spark, sf_dir):
    from ..operators.emission import number

    df = view(spark, sf_dir)
    dots = number(df.filter(F.col("dot")).select("r", "c", "score"))
    return metric.hits(dots, df.filter(F.col("truth"))).select("rank", "hit")


@query(sql(f"SELECT rank, {n6('avg(hit::INT) OVER (ORDER BY rank ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)')} AS rate FROM h", *_CURVE))
def marginal_hit_rate(spark, sf_dir):
    return P.rolling_rate(_curve(spark, sf_dir), 50).select("rank", r6("rate").alias("rate"))


_SCORE = "1000 * (1 - exp(-3 * cum / 1000::DOUBLE)) / (0.2 * (1000 * (1 - exp(-3 * cum / 1000::DOUBLE))) + 0.2 * (rank - 0.5 * cum) + 0.8 * 1000)"


@query(sql(f"SELECT rank, cum, {n6('s')} AS score FROM (SELECT *, {_SCORE} AS s FROM (SELECT rank, sum(hit::INT) OVER (ORDER BY rank)::BIGINT AS cum FROM h)) ORDER BY round(s, 9) DESC, rank LIMIT 1", *_CURVE))
def price_curve_argmax(spark, sf_dir):
    c = P.prefix_rate(_curve(spark, sf_dir)).select("rank", "cum", P.forward(F.col("rank"), F.col("cum"), 1000.0).alias("s"))
    return c.orderBy(F.desc(F.round("s", 9)), "rank").limit(1).select("rank", "cum", r6("s").alias("score"))


_GRID = [100, 200, 400, 800, 1600]


@query(sql(f"""SELECT rank AS n, {n6('(cum - lag(cum, 1, 0) OVER w) / (rank - lag(rank, 1, 0) OVER w)::DOUBLE')} AS marginal, {n6('0.2 * s / (3 * exp(-3 * cum / 1000::DOUBLE) * (1 - 0.2 * s) + 0.2 * s * 0.5)')} AS price
  FROM (SELECT *, {_SCORE} AS s FROM (SELECT rank, sum(hit::INT) OVER (ORDER BY rank)::BIGINT AS cum FROM h)) WHERE rank IN (100, 200, 400, 800, 1600) WINDOW w AS (ORDER BY rank)""", *_CURVE))  # fmt: skip
def break_even_budget(spark, sf_dir):
    """Hits per dot of each step between budgets against the rate at which a step pays nothing."""
    from pyspark.sql import Window

    c = P.prefix_rate(_curve(spark, sf_dir)).filter(F.col("rank").isin(_GRID)).withColumn("s", P.forward(F.col("rank"), F.col("cum"), 1000.0))
    w = Window.orderBy("rank")  # a handful of budgets
    step = (F.col("cum") - F.lag("cum", 1, 0).over(w)) / (F.col("rank") - F.lag("rank", 1, 0).over(w))
    return c.select(F.col("rank").alias("n"), r6(step).alias("marginal"), r6(P.break_even(F.col("s"), F.col("cum"), 1000.0)).alias("price"))


@query(f"""
WITH k AS (SELECT o_orderpriority, count(*)::DOUBLE AS k FROM orders GROUP BY 1), n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
g AS (SELECT n.c_nationkey AS plan, n, k, 0.15::DOUBLE * pow(2000::DOUBLE / n, 0.3) AS w FROM n, k),
s AS (SELECT plan, n, k * (1 - exp(-1.2 * n * w / k)) / (0.2 * (k * (1 - exp(-1.2 * n * w / k))) + 0.2 * n + 0.8 * k) AS s FROM g)
SELECT plan, n, {n6("min(s)")} AS worst, row_number() OVER (ORDER BY round(min(s), 9) DESC, plan) = 1 AS best FROM s GROUP BY plan, n
""")
def maximin_budget(spark, sf_dir):
    """Budgets (a nation's customers) by their worst score over truth sizes (orders of a priority), and the best of them."""
    n = L.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("plan")).agg(F.count(F.lit(1)).alias("n"))
    k = L.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("k"))
    return P.maximin(n, "plan", "n", k, "k", 1.2, 0.15, 0.3).withColumn("worst", r6("worst"))


# -- tests ------------------------------------------------------------------------

_OUT = "o AS (SELECT c_nationkey::VARCHAR AS candidate, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, (c_custkey * 7919) % 10 < 4 + c_nationkey % 5 AS win, c_acctbal / 1000 + c_nationkey % 7 - 4 AS delta FROM customer)"
_UP, _LOW = P.bounds()
_W, _L = P.steps(0.5, 0.7)


def _decide(body: str) -> str:
    return f"""WITH {_OUT}, {body},
z AS (SELECT candidate, count(*) AS total, coalesce(min(k) FILTER (llr >= {d(_UP)} OR llr <= {d(_LOW)}), max(k)) AS stopped_at FROM l GROUP BY 1)
SELECT z.candidate, total, stopped_at, {n6('llr')} AS llr, CASE WHEN llr >= {d(_UP)} THEN 'accept_H1' WHEN llr <= {d(_LOW)} THEN 'accept_H0' ELSE 'continue' END AS decision FROM z JOIN l ON l.candidate = z.candidate AND l.k = stopped_at"""


def _outcomes(spark, sf_dir):
    from pyspark.sql import Window

    c = L.table(spark, sf_dir, "customer")
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return c.select(F.col("c_nationkey").cast("string").alias("candidate"), k.alias("k"), ((F.col("c_custkey") * 7919) % 10 < 4 + F.col("c_nationkey") % 5).alias("win"), (F.col("c_acctbal") / 1000 + F.col("c_nationkey") % 7 - 4).alias("delta"))


@query(_decide(f"l AS (SELECT *, sum(win::INT) OVER w * {d(_W)} + (count(*) OVER w - sum(win::INT) OVER w) * {d(_L)} AS llr FROM o WINDOW w AS (PARTITION BY candidate ORDER BY k))"))
def sprt_sign(spark, sf_dir):
    return P.sprt_sign(_outcomes(spark, sf_dir)).withColumn("llr", r6("llr"))


@query(_decide("l AS (SELECT o.*, 0.5 / s * sum(delta) OVER w - count(*) OVER w * 0.125 AS llr FROM o JOIN (SELECT candidate, stddev_samp(delta) AS s FROM o GROUP BY 1) USING (candidate) WINDOW w AS (PARTITION BY candidate ORDER BY k))"))
def sprt_normal_mean(spark, sf_dir):
    return P.sprt_mean(_outcomes(spark, sf_dir)).withColumn("llr", r6("llr"))


@query(_decide(f"l AS (SELECT *, sum(win::INT) OVER w * {d(_W)} + (count(*) OVER w - sum(win::INT) OVER w) * {d(_L)} AS llr FROM o WINDOW w AS (PARTITION BY candidate ORDER BY k))").replace("AS decision FROM", f"AS decision, CASE WHEN llr >= {d(P.bounds(boundary='wald')[0])} THEN 'accept_H1' WHEN llr <= {d(P.bounds(boundary='wald')[1])} THEN 'accept_H0' ELSE 'continue' END AS other FROM"))
def sprt_both_boundaries(spark, sf_dir):
    """The sign test with what the other boundary would have decided at the same ratio."""
    return P.other_boundary(P.sprt_sign(_outcomes(spark, sf_dir))).withColumn("llr", r6("llr"))


#: Error rates and hypotheses of each supplier's test, as columns of the table, and the same in SQL.
_RATES = "q AS (SELECT s_suppkey AS test, (1 + s_suppkey % 9) / 100::DOUBLE AS alpha, (5 + s_nationkey) / 100::DOUBLE AS beta, (40 + s_suppkey % 13) / 100::DOUBLE AS p0, (60 + s_nationkey) / 100::DOUBLE AS p1 FROM supplier), b AS (SELECT *, 'ville' AS boundary, ln(1 / alpha) AS up, ln(beta) AS low FROM q UNION ALL SELECT *, 'wald', ln((1 - beta) / alpha), ln(beta / (1 - alpha)) FROM q)"


def _rates(spark, sf_dir):
    s = L.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("test"), ((1 + F.col("s_suppkey") % 9) / 100.0).alias("alpha"), ((5 + F.col("s_nationkey")) / 100.0).alias("beta"), ((40 + F.col("s_suppkey") % 13) / 100.0).alias("p0"), ((60 + F.col("s_nationkey")) / 100.0).alias("p1"))


def _both(df, columns):
    """A row per boundary: columns maps a boundary to the columns of its row."""
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("boundary"), *(v.alias(k) for k, v in columns(b).items())) for b in ("ville", "wald"))))
    return df.select("test", rows.alias("x")).select("test", "x.*")


@query(f"WITH {_RATES} SELECT test, boundary, {n6('up')} AS upper, {n6('low')} AS lower FROM b")
def sprt_bounds(spark, sf_dir):
    return _both(_rates(spark, sf_dir), lambda b: dict(zip(("upper", "lower"), map(r6, P.bounds_of(F.col("alpha"), F.col("beta"), b)), strict=True)))


@query(f"WITH {_RATES} SELECT test, boundary, ceil(up / ln(p1 / p0) - 1e-12)::BIGINT AS wins, ceil(low / ln((1 - p1) / (1 - p0)) - 1e-12)::BIGINT AS losses FROM b")
def folds_needed(spark, sf_dir):
    return _both(_rates(spark, sf_dir), lambda b: dict(zip(("wins", "losses"), P.folds_of(F.col("p0"), F.col("p1"), F.col("alpha"), F.col("beta"), b), strict=True)))


# -- correlations -------------------------------------------------------------------

_NATION = "t AS (SELECT c_nationkey AS k, sum(round(c_acctbal * 100)::BIGINT) / 10000000 AS x, count(*) AS y, max(c_custkey) % 11 AS z FROM customer GROUP BY 1)"


def _nations(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("k")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / 10000000).alias("x"), F.count(F.lit(1)).alias("y"), (F.max("c_custkey") % 11).alias("z"))


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query(f"WITH {_NATION} SELECT {n6('corr(a, b)')} AS rho, count(*) AS n FROM (SELECT {_AVG_RANK.format('x')} AS a, {_AVG_RANK.format('y')} AS b FROM t)")
def spearman(spark, sf_dir):
    return P.spearman(_nations(spark, sf_dir), "x", "y").select(r6("rho").alias("rho"), "n")


@query(f"""WITH {_NATION}, r AS (SELECT k, row_number() OVER (ORDER BY x, k) - 1 AS x, row_number() OVER (ORDER BY y, k) - 1 AS y, row_number() OVER (ORDER BY z, k) - 1 AS z FROM t),
f AS (SELECT regr_slope(x, z) AS sx, regr_intercept(x, z) AS ix, regr_slope(y, z) AS sy, regr_intercept(y, z) AS iy FROM r),
e AS (SELECT k, round(x - ix - sx * z, 9) AS x, round(y - iy - sy * z, 9) AS y FROM r, f)
SELECT {n6('corr(a, b)')} AS rho, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY x, k) - 1 AS a, row_number() OVER (ORDER BY y, k) - 1 AS b FROM e)""")
def partial_spearman(spark, sf_dir):
    return P.partial_spearman(_nations(spark, sf_dir), "x", "y", "z", "k").select(r6("rho").alias("rho"), "n")


@query(sql(f"SELECT {n6('sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n))')} AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM lat WHERE foot GROUP BY 1))"))
def roc_auc(spark, sf_dir):
    return P.auc(view(spark, sf_dir).filter(F.col("foot")), "score", "truth").withColumn("auc", r6("auc"))


@query(sql(f"SELECT {n6('sum(mid * t) / sum(t)')} AS lift, sum(t)::BIGINT AS truths FROM (SELECT (2 * sum(n) OVER (ORDER BY score) - n) / 2.0::DOUBLE / sum(n) OVER () AS mid, t FROM (SELECT score, count(*) AS n, count(*) FILTER (truth) AS t FROM lat WHERE foot GROUP BY 1))"))
def rank_lift(spark, sf_dir):
    return P.rank_lift(view(spark, sf_dir).filter(F.col("foot")), "score", "truth").withColumn("lift", r6("lift"))


@query(f"WITH {_NATION} SELECT k, passed, {n6('x')} AS x FROM (SELECT *, y > 55 AND z < 8 AS passed FROM t) ORDER BY passed DESC, x DESC, k LIMIT 1")
def promotion_gate(spark, sf_dir):
    best = P.promote(_nations(spark, sf_dir), (F.col("y") > 55) & (F.col("z") < 8), "x", "k")
    return best.select("k", "passed", r6("x").alias("x"))


# -- sets -------------------------------------------------------------------------------


@query(sql(f"""SELECT name, n_b, common, {n6('common / (n_a + n_b - common)::DOUBLE')} AS jaccard, {n6('common / n_a::DOUBLE')} AS a_in_b, {n6('common / n_b::DOUBLE')} AS b_in_a,
  common / (n_a + n_b - common)::DOUBLE < 0.5 AND (common / n_a::DOUBLE < 0.9 OR n_b > 10 * n_a) AS passes FROM (
  SELECT okey % 5 AS name, count(*) AS n_b, count(*) FILTER (dot) AS common FROM lat WHERE foot AND okey IS NOT NULL GROUP BY 1), (SELECT count(*) AS n_a FROM lat WHERE dot)"""))  # fmt: skip
def jaccard_uniqueness(spark, sf_dir):
    df = view(spark, sf_dir)
    b = df.filter(F.col("foot") & F.col("okey").isNotNull()).select("r", "c", (F.col("okey") % 5).alias("name"))
    o = A.unique_gate(A.overlap(df.filter(F.col("dot")).select("r", "c"), b, "name"))
    return o.select("name", "n_b", "common", *(r6(x).alias(x) for x in ("jaccard", "a_in_b", "b_in_a")), "passes")


@query(sql("""SELECT count(*) FILTER (dot) AS n_base, count(*) FILTER (p) AS n_pruned, count(*) FILTER (p AND NOT dot) AS added, count(*) FILTER (dot AND NOT p) AS removed, count(*) FILTER (dot AND NOT p AND near) AS removed_near
FROM (SELECT dot, dot AND s.d IS NULL AS p, s.d IS NOT NULL AS near FROM lat l LEFT JOIN s ON s.r = l.r AND s.c = l.c)""", "p AS (SELECT r, c FROM lat WHERE cat)", _NEAR("s", "p", 2)))  # fmt: skip
def nested_subset_check(spark, sf_dir):
    df = view(spark, sf_dir)
    base = df.filter(F.col("dot"))
    return A.nested(base, T.beyond(base, df.filter("cat"), 2), T.near(df.filter("cat"), 2))


@query(sql("""SELECT * FROM (
SELECT 'cells' AS check, count(*) = 17900 AS ok, count(*) AS found FROM lat UNION ALL
SELECT 'not_finite_inside', count(*) FILTER (foot AND v IS NULL) = 0, count(*) FILTER (foot AND v IS NULL) FROM x UNION ALL
SELECT 'out_of_range', count(*) FILTER (foot AND (v < 0 OR v > 1)) = 0, count(*) FILTER (foot AND (v < 0 OR v > 1)) FROM x UNION ALL
SELECT 'nonzero_outside', count(*) FILTER (NOT foot AND v <> 0) = 0, count(*) FILTER (NOT foot AND v <> 0) FROM x UNION ALL
SELECT 'positive', count(*) FILTER (foot AND v > 0) > 0, count(*) FILTER (foot AND v > 0) FROM x UNION ALL
SELECT 'off_grid', TRUE, 0)""", "x AS (SELECT foot, score AS v FROM lat)"))  # fmt: skip
def format_audit(spark, sf_dir):
    return A.format_audit(view(spark, sf_dir), "score", F.col("foot"), HEIGHT, WIDTH)


@query("""WITH t AS (SELECT DISTINCT o_orderpriority AS name, (o_orderkey % 97)::INT AS r, (o_custkey % 89)::INT AS c FROM orders),
a AS (SELECT name, r, c FROM t UNION ALL SELECT 'copy of ' || name, r, c FROM t WHERE name[1] IN ('1', '3') UNION ALL SELECT 'part of ' || name, r, c FROM t WHERE r < 90),
p AS (SELECT name, string_agg(r || ':' || c, ',' ORDER BY r, c) AS cells, count(*) AS n FROM a GROUP BY 1)
SELECT first, name AS other, n FROM (SELECT *, min(name) OVER (PARTITION BY cells) AS first FROM p) WHERE name <> first""")
def exact_duplicate(spark, sf_dir):
    """Rasters of all orders, of which some are copies, some are parts of another and most are like no other."""
    o = L.table(spark, sf_dir, "orders")
    rasters = o.select(F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 97).cast("int").alias("r"), (F.col("o_custkey") % 89).cast("int").alias("c"), F.lit(1).alias("v")).distinct()
    copies = rasters.filter(F.substring("name", 1, 1).isin("1", "3")).withColumn("name", F.concat(F.lit("copy of "), "name"))
    parts = rasters.filter("r < 90").withColumn("name", F.concat(F.lit("part of "), "name"))
    return A.same_cells(rasters.unionByName(copies).unionByName(parts), "name", "v")


@query(sql("SELECT r // 64 AS block, sha256(string_agg(h, '' ORDER BY r)) AS sha256 FROM (SELECT r, sha256(string_agg(c || ':' || n, ',' ORDER BY c)) AS h FROM lat GROUP BY 1) GROUP BY 1"))
def raster_digest(spark, sf_dir):
    return A.digest(view(spark, sf_dir), "n", 64).select("block", "sha256")


# -- learners and streams ------------------------------------------------------------------


@query()
def blocked_oof_gbt(spark, sf_dir):
    df = filled(spark, sf_dir).filter(F.col("foot")).withColumn("fold", H.uniform_block(HEIGHT, WIDTH, 2, 1))
    return learners.out_of_fold(df, ["n", "px", "disc", "tax", "score"], F.col("truth"), "fold", 2, 120_000, 480_000, rounds=180, least=60).select("r", "c", "fold", "prob")


@query(sql("SELECT r, c, fold FROM (SELECT r, c, CASE WHEN r >= 179 THEN 1 ELSE 0 END AS fold, row_number() OVER (PARTITION BY r >= 179 ORDER BY ('0x' || substr(md5('5:' || r || ':' || c), 1, 15))::BIGINT, r, c) AS k FROM lat WHERE foot) WHERE k <= 1500"))
def exact_sample(spark, sf_dir):
    """1,500 cells of each half, drawn without replacement."""
    from ..operators.sampling import exact_sample as draw

    df = view(spark, sf_dir).filter("foot").select("r", "c", H.uniform_block(HEIGHT, WIDTH, 2, 1).alias("fold"))
    return draw(df, "fold", 1500, ["r", "c"], 5).select("r", "c", "fold")


@query(sql(f"SELECT r, c, {n6('s')} AS corridor FROM g", "p AS (SELECT r, c FROM lat WHERE truth)", _NEAR("b", "p", 3), "k AS (SELECT l.r, l.c, coalesce(greatest(1 - d / 3, 0), 0) AS k FROM lat l LEFT JOIN b ON b.r = l.r AND b.c = l.c)", smooth_sql("g", "k", {"s": ("k", 1.0, 0, 0)})))
def corridor_field(spark, sf_dir):
    """Gaussian of the credit of truth cells."""
    from ..operators.stencil import smooth

    df = view(spark, sf_dir)
    near = T.near(df.filter(F.col("truth")), 3).select("r", "c", F.greatest(1 - F.col("d") / 3, F.lit(0.0)).alias("k"))
    return smooth(df.select("r", "c").join(near, ["r", "c"], "left").fillna(0.0, ["k"]), {"s": ("k", 1.0, 0, 0)}).select("r", "c", r6("s").alias("corridor"))


@query()
def gated_emission(spark, sf_dir):
    """The best candidate field by lift, emitted to a budget: what passes the gate becomes dots."""
    from ..operators.emission import emit

    df = view(spark, sf_dir).withColumn("alt", F.lit(1.0) - F.col("score"))
    lifts = {x: P.rank_lift(df.filter(F.col("foot")), x, "truth").first()["lift"] for x in ("score", "alt")}  # two numbers
    best = max(sorted(lifts), key=lambda k: round(lifts[k], 9))
    return emit(_allowed(df), best, 2.8).filter("rank <= 100").select("rank", "r", "c")


@query(f"SELECT candidate, stopped_at::INT AS n, decision FROM ({SQL['sprt_sign']})")
def sprt_stream(spark, sf_dir):
    """Decisions of the streaming test after all micro-batches, one row per candidate."""
    import uuid

    from ..operators.components import shared_dir
    from ..streaming.sprt import sprt_stream as stream

    at = f"{shared_dir(spark)}/gridloom/stream-{uuid.uuid4().hex}"
    rows = _outcomes(spark, sf_dir).select("candidate", F.col("k").cast("int").alias("k"), "win")
    rows.repartition(2).write.parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    q = stream(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(f"{at}/out")
    return done.filter("NOT rejected").groupBy("candidate").agg(F.max("n").cast("int").alias("n"), F.max(F.struct("n", "decision"))["decision"].alias("decision"))


@query(f"SELECT candidate, stopped_at::INT AS n, decision, other FROM ({SQL['sprt_both_boundaries']})")
def sprt_ledger(spark, sf_dir):
    """Tests as the stateful stream's checkpoint holds their last counted outcome, with both boundaries' decisions; outcomes come in no order."""
    import uuid

    from ..session import shared_dir
    from ..streaming.ledger import sign_test_stream

    at = f"{shared_dir(spark)}/gridloom/ledger-{uuid.uuid4().hex}"
    rows = _outcomes(spark, sf_dir).select("candidate", F.col("k").cast("int").alias("k"), "win", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k")).alias("at"))
    rows.repartition(4, F.xxhash64("candidate", "k")).write.parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    q = sign_test_stream(source, patience_ms=10**9, delay="10 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{at}/out").filter("state = 'counted'").groupBy("candidate").agg(F.max(F.struct("n", "decision", "other")).alias("x"))
    return last.select("candidate", "x.n", "x.decision", "x.other")


@query()
def calibrated_fit(spark, sf_dir):
    """(k, a) of the saturating score from tens of artifacts, and the error left."""
    import numpy as np

    t = _nations(spark, sf_dir).orderBy("k").collect()  # a row per nation: 25
    n = np.array([1000 + 900 * r.k for r in t], float)
    w = np.array([0.1 + 0.004 * (r.z % 7) for r in t])
    tp = 5800 * (1 - np.exp(-1.17 * n * w / 5800))
    k, a, error = P.fit_saturating(n, w, tp / (0.2 * tp + 0.2 * n + 0.8 * 5800))
    return spark.createDataFrame([(k, a, error)], "k double, a double, error double").select(F.round("k", 1).alias("k"), F.round("a", 3).alias("a"), F.round("error", 5).alias("error"))


@query(sql("SELECT count(*) AS cells, count(*) FILTER (foot) AS inside, round(sum(CASE WHEN foot THEN score::FLOAT::DOUBLE ELSE 0 END), 3) AS total FROM lat"))
def raster_round_trip(spark, sf_dir):
    """A raster written with its checks and read again on the same grid."""
    import uuid

    from ..operators.components import shared_dir
    from ..sources import raster

    grid = raster.Grid(HEIGHT, WIDTH, "local", 200000.0, 100.0, 400000.0, -100.0)
    path = f"{shared_dir(spark)}/gridloom/raster-{uuid.uuid4().hex}"
    raster.write_raster(view(spark, sf_dir), ["score"], grid, path, F.col("foot"))
    back = raster.read_raster(spark, path, ["score"], grid)
    return back.agg(F.count(F.lit(1)).alias("cells"), F.count("score").alias("inside"), F.round(F.sum(F.col("score").cast("double")), 3).alias("total"))
