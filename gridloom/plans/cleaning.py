"""Queries on sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lattice as L
from .base import n6, query, r6


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view', 'purchase')) WHERE k = 1
""")
def csv_dedupe_first_per_key(spark, sf_dir):
    good = L.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase")).select("user_id", "event_id", "event_type", "value", "ts")
    return L.first_per_key(good, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH p AS (
  SELECT s_suppkey % 358 + (s_nationkey % 4) * 0.25::DOUBLE AS y, s_suppkey % 50 + 0.25::DOUBLE AS x, s_acctbal AS v, 1 + s_nationkey % 3 AS w FROM supplier
  UNION ALL SELECT c_custkey % 358 + (c_nationkey % 4) * 0.25::DOUBLE, c_custkey % 50 + 0.25::DOUBLE, c_acctbal, 1 + c_nationkey % 3 FROM customer)
SELECT round_even(y, 0)::INT AS r, round_even(x, 0)::INT AS c, count(*) AS points, {n6("sum(v * w) / sum(w)")} AS value
FROM p WHERE round_even(y, 0) BETWEEN 0 AND 357 AND round_even(x, 0) BETWEEN 0 AND 49 GROUP BY 1, 2
""")
def points_to_cells_weighted_mean(spark, sf_dir):
    def points(name, key, nation, v):
        t = L.table(spark, sf_dir, name)
        return t.select((F.col(key) % 358 + F.col(nation) % 4 * 0.25).alias("y"), (F.col(key) % 50 + 0.25).alias("x"), F.col(v).alias("v"), (1 + F.col(nation) % 3).alias("w"))

    p = points("supplier", "s_suppkey", "s_nationkey", "s_acctbal").unionByName(points("customer", "c_custkey", "c_nationkey", "c_acctbal"))
    return L.points_to_cells(p, "y", "x", "v", "w").withColumn("value", r6("value"))


@query("""
SELECT count(*) AS n, count(*) FILTER (abs(r - rr) > 1 OR abs(c - cc) > 1) AS mismatches,
  count(*) FILTER (abs(r - rr) > 1 OR abs(c - cc) > 1) <= greatest(5, 0.01 * count(*)) AS consistent FROM (
  SELECT c_custkey % 358 AS r, c_custkey % 50 AS c, floor((400000 - (400000 - 100 * (c_custkey % 358) - 50)) / 100) + (CASE WHEN c_custkey % 97 = 0 THEN 5 ELSE 0 END) AS rr,
    floor((200000 + 100 * (c_custkey % 50) + 50 - 200000) / 100) AS cc FROM customer)
""")
def coordinate_crosscheck(spark, sf_dir):
    """Rows and columns against projected coordinates by the affine of the grid: at most 5 or 1 % may differ."""
    t = L.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 358).alias("r"), (F.col("c_custkey") % 50).alias("c"), (F.col("c_custkey") % 97 == 0).alias("shifted"))
    east, north = 200000 + 100 * F.col("c") + 50, 400000 - 100 * F.col("r") - 50
    rr = F.floor((400000 - north) / 100) + F.when(F.col("shifted"), 5).otherwise(0)
    cc = F.floor((east - 200000) / 100)
    off = (F.abs(F.col("r") - rr) > 1) | (F.abs(F.col("c") - cc) > 1)
    return t.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).alias("mismatches")).withColumn("consistent", F.col("mismatches") <= F.greatest(F.lit(5.0), 0.01 * F.col("n")))


@query(f"""
SELECT c_nationkey AS grp, count(*) AS n, {n6("((degrees(atan2(avg(sin(radians(2 * a))), avg(cos(radians(2 * a))))) / 2) + 180) - 180 * floor(((degrees(atan2(avg(sin(radians(2 * a))), avg(cos(radians(2 * a))))) / 2) + 180) / 180)")} AS azimuth
FROM (SELECT c_nationkey, (c_custkey * 37 % 70 + 20)::DOUBLE AS a FROM customer) GROUP BY 1
""")
def circular_mean(spark, sf_dir):
    """Mean of axes: angles are doubled, so 1 and 179 degrees are two apart."""
    t = L.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), (F.col("c_custkey") * 37 % 70 + 20).cast("double").alias("a"))
    m = t.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin(F.radians(2 * F.col("a")))).alias("s"), F.avg(F.cos(F.radians(2 * F.col("a")))).alias("c"))
    return m.select("grp", "n", r6(F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0))).alias("azimuth"))


@query(f"""
SELECT o_orderpriority, count(*) AS n, {n6("avg(least(greatest(o_totalprice, 20000), 400000))")} AS mean_price
FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1
""")
def quality_filter_winsorize(spark, sf_dir):
    t = L.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F"))
    return t.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.least(F.greatest(F.col("o_totalprice"), F.lit(20000.0)), F.lit(400000.0)))).alias("mean_price"))


@query("""
WITH a AS (
  SELECT source || ':' || (doc_id % 13) AS name, CASE WHEN quality = 0 THEN 'NA' ELSE doc_id::VARCHAR END AS score, 0 AS rank FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0
  UNION ALL SELECT source || ':' || (doc_id % 13), doc_id::VARCHAR, 1 FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1)
SELECT name, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, score) AS k FROM a WHERE score NOT IN ('NA', '')) WHERE k = 1
""")
def ledger_first_wins(spark, sf_dir):
    t = L.table(spark, sf_dir, "documents").join(L.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.concat_ws(":", "source", (F.col("doc_id") % 13).cast("string")).alias("name"), "quality")
    one = t.filter("doc_id % 2 = 0").select("name", F.when(F.col("quality") == 0, "NA").otherwise(F.col("doc_id").cast("string")).alias("score"))
    two = t.filter("doc_id % 2 = 1").select("name", F.col("doc_id").cast("string").alias("score"))
    return L.union_first_wins(one, two, key="name", value="score")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_properties(spark, sf_dir):
    t = L.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("""
SELECT l_returnflag || '-' || l_linestatus AS code, count(TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE l_quantity::VARCHAR END AS DOUBLE)) AS parsed,
  count(*) AS n FROM lineitem GROUP BY 1
""")
def cast_or_skip(spark, sf_dir):
    t = L.table(spark, sf_dir, "lineitem").withColumn("text", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")))
    return t.groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("code")).agg(F.count(L.to_number(F.col("text"))).alias("parsed"), F.count(F.lit(1)).alias("n"))
