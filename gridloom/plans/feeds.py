"""Queries on sources and sinks: tables and rasters are written in the shared folder and read again by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.components import shared_dir
from ..sources import raster, sinks, tables
from ..sources import lattice as L
from ..sources.lattice import HEIGHT, WIDTH
from .base import n6, query, r6, sql, view
from .space import _EDT, NEAREST

GRID = raster.Grid(HEIGHT, WIDTH, "local", 200000.0, 100.0, 400000.0, -100.0)


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def _csv(spark, df, name: str):
    """The table as a CSV that was written and is read as text."""
    path = _place(spark, name)
    sinks.write_csv(df, path)
    return tables.first_readable(spark, [f"{path}-elsewhere", path])


_X, _Y = "200000 + 100 * ({k} % 50) + 30", "400000 - 100 * ({k} % 358) - 40"


@query(f"""
WITH w AS (SELECT c_custkey // 3 AS id, c_custkey % 4 AS kind, c_mktsegment AS code, {_X.format(k='c_custkey')} AS x, {_Y.format(k='c_custkey')} AS y, c_acctbal / 10 AS v, c_custkey % 11 = 0 AS broken FROM customer),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x, y, v) AS k FROM w WHERE kind < 3 AND code IN ('BUILDING', 'MACHINERY') AND NOT broken)
SELECT ((400000 - y) // 100)::INT AS r, ((x - 200000) // 100)::INT AS c, count(*) AS points, {n6('avg(least(greatest(v, 20), 400))')} AS value FROM g WHERE k = 1 GROUP BY 1, 2
""")
def heat_flow_csv(spark, sf_dir):
    """Wells from a CSV: kinds, codes, numbers or not, first row of an id, drawn to limits, mean per cell."""
    t = L.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    wells = t.select(F.when(k % 4 < 3, "Point").otherwise("Line").alias("kind"), F.floor(k / 3).alias("unique_id"), F.col("c_mktsegment").alias("code"), (200000 + 100 * (k % 50) + 30).alias("x"), (400000 - 100 * (k % 358) - 40).alias("y"), F.when(k % 11 == 0, F.lit("n/a")).otherwise((F.col("c_acctbal") / 10).cast("string")).alias("value"))
    out = tables.heat_flow(_csv(spark, wells, "heat"), GRID, codes=("BUILDING", "MACHINERY"))
    return out.select("r", "c", "points", r6("value").alias("value"))


@query(f"""
WITH s AS (SELECT l_orderkey * 31 % 5000 + 200000 AS x0, 400000 - l_partkey * 17 % 35000 AS y0, l_quantity * 10 AS length, (l_linenumber * 37 + l_suppkey * 11) % 180 AS a, l_discount * 10 AS v FROM lineitem),
m AS (SELECT floor((400000 - (y0 + y0 - 60) / 2.0) / 100)::INT AS r, floor(((x0 + x0 + 60) / 2.0 - 200000) / 100)::INT AS c, length, radians(2 * a) AS t, v FROM s WHERE length >= 200)
SELECT r, c, count(*) AS points, {n6('sum(v * length) / sum(length)')} AS value, round(sqrt(pow(sum(sin(t) * length), 2) + pow(sum(cos(t) * length), 2)), 3) AS pull FROM m WHERE r BETWEEN 0 AND 357 AND c BETWEEN 0 AND 49 GROUP BY 1, 2
""")
def stress_csv(spark, sf_dir):
    """Segments from a CSV: middles, least length, weights by length; pull is how strongly the axes of a cell agree, from the mean axis."""
    t = L.table(spark, sf_dir, "lineitem")
    s = t.select(F.col("l_orderkey") * 31 % 5000 + 200000, 400000 - F.col("l_partkey") * 17 % 35000, F.col("l_quantity") * 10, (F.col("l_linenumber") * 37 + F.col("l_suppkey") * 11) % 180, F.col("l_discount") * 10).toDF("x0", "y0", "length", "azimuth", "value").withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") - 60})
    raw = _csv(spark, s, "stress")
    out = tables.stress(raw, GRID)
    # along the mean axis, the sum of the components of all segments is the length of the mean vector
    v = raw.select(*(F.col(x).cast("double").alias(x) for x in ("x0", "y0", "x1", "y1", "azimuth", "length"))).filter("length >= 200")
    r, c = GRID.cell((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    along = v.select(r.alias("r"), c.alias("c"), "length", F.col("azimuth").alias("own")).join(out, ["r", "c"]).groupBy("r", "c").agg(F.first("points").alias("points"), F.first("value").alias("value"), F.sum(F.cos(F.radians(2 * (F.col("own") - F.col("azimuth")))) * F.col("length")).alias("pull"))
    return along.select("r", "c", "points", r6("value").alias("value"), (F.round("pull", 3) + F.lit(0.0)).alias("pull"))


@query("""
SELECT (s_suppkey % 358)::INT AS r, (s_suppkey % 50)::INT AS c, greatest(CASE WHEN s_acctbal / 20 BETWEEN 20 AND 400 THEN s_acctbal / 20 END, CASE WHEN s_suppkey % 150 BETWEEN 20 AND 400 THEN (s_suppkey % 150)::DOUBLE END, CASE WHEN s_nationkey * 3 BETWEEN 20 AND 400 THEN (s_nationkey * 3)::DOUBLE END) AS temperature,
  s_nationkey % 9 = 0 OR coalesce(greatest(CASE WHEN s_acctbal / 20 BETWEEN 20 AND 400 THEN s_acctbal / 20 END, CASE WHEN s_suppkey % 150 BETWEEN 20 AND 400 THEN (s_suppkey % 150)::DOUBLE END, CASE WHEN s_nationkey * 3 BETWEEN 20 AND 400 THEN (s_nationkey * 3)::DOUBLE END) >= 65, FALSE) AS hot FROM supplier
""")
def wells_csv(spark, sf_dir):
    """Three thermometers, and whether a well is hot."""
    t = L.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    w = t.select((k % 358).alias("row"), (k % 50).alias("col"), (200000 + 100 * (k % 50) + 50).alias("x"), (400000 - 100 * (k % 358) - 50).alias("y"), (F.col("s_acctbal") / 20).alias("t1"), (k % 150).alias("t2"), (F.col("s_nationkey") * 3).alias("t3"), F.when(F.col("s_nationkey") % 9 == 0, "Hot spring").otherwise("cold").alias("class"))
    return tables.wells(_csv(spark, w, "wells"), GRID)


@query(f"""
SELECT (p_partkey % 358)::INT AS r, (p_partkey % 50)::INT AS c, count(*) AS points, {n6('sum(p_retailprice * greatest(p_size - 10, 1)) / sum(greatest(p_size - 10, 1))')} AS value FROM part
WHERE p_partkey % 5 < 3 AND p_partkey % 7 IN (0, 2) GROUP BY 1, 2
""")
def fault_traces_csv(spark, sf_dir):
    t = L.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    f = t.select((k % 358).alias("row"), (k % 50).alias("col"), F.col("p_retailprice").alias("rate"), (F.col("p_size") - 10).alias("length"), F.when(k % 5 < 3, "TRUE").otherwise("no").alias("flag"), F.concat(F.lit("age "), (k % 7).cast("string")).alias("age"))
    out = tables.fault_traces(_csv(spark, f, "faults"), GRID, ("true", "1"), ("age 0", "age 2"))
    return out.select("r", "c", "points", r6("value").alias("value"))


@query(sql(f"SELECT r, c, {n6('exp(-d2 / 72.0::DOUBLE)')} AS value FROM e", _EDT.format(mask="r * 50 + c IN (SELECT (s_suppkey * 7 % 358) * 50 + s_suppkey % 50 FROM supplier UNION SELECT (n_nationkey * 13) * 50 + n_nationkey FROM nation)")))
def point_proximity(spark, sf_dir):
    """Nearness to the points of two CSVs."""
    s, n = L.table(spark, sf_dir, "supplier"), L.table(spark, sf_dir, "nation")
    one = _csv(spark, s.select((F.col("s_suppkey") * 7 % 358 + 0.4).alias("row"), (F.col("s_suppkey") % 50 + 0.7).alias("col")), "springs")
    two = _csv(spark, n.select((F.col("n_nationkey") * 13).alias("row"), F.col("n_nationkey").alias("col")), "vents")
    return tables.proximity(L.frame(spark), [one, two]).select("r", "c", r6("value").alias("value"))


@query(sql(f"SELECT l.r, l.c, {n6('a.v')} AS tax_layer, b.n AS n_layer FROM lat l LEFT JOIN (SELECT r, c, tax AS v FROM lat WHERE dot) a ON a.r = l.r AND a.c = l.c LEFT JOIN (SELECT r, c, n FROM lat WHERE off) b ON b.r = l.r AND b.c = l.c"))
def load_all_layers(spark, sf_dir):
    df = view(spark, sf_dir)
    layers = {"tax_layer": df.filter("dot").select("r", "c", F.col("tax").alias("value")), "n_layer": df.filter("off").select("r", "c", F.col("n").alias("value"))}
    return tables.load_all(L.frame(spark), layers).select("r", "c", r6("tax_layer").alias("tax_layer"), "n_layer")


# -- rasters -------------------------------------------------------------------------


def _bytes_raster(spark, sf_dir):
    """A raster of byte bands, as a camera writes it."""
    path = _place(spark, "bytes")
    df = view(spark, sf_dir)
    raster.write_raster(df, ["score"], GRID, path, F.col("foot"))
    cells = df.select("r", "c", *((F.coalesce(F.col(b), F.lit(0)) % 256).cast("short").alias(x) for x, b in (("b1", "okey"), ("b2", "n"))), F.lit(0).alias("tr"), F.lit(0).alias("tc"))
    cells.write.mode("overwrite").partitionBy("tr", "tc").parquet(f"{path}/cells")
    return path, df


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN (coalesce(okey, 0) % 256) / 255.0::DOUBLE ELSE 0 END')} AS b1, {n6('CASE WHEN foot THEN (n % 256) / 255.0::DOUBLE ELSE 0 END')} AS b2 FROM lat"))
def ratio_bands(spark, sf_dir):
    path, _ = _bytes_raster(spark, sf_dir)
    inside = F.col("r").between(2, HEIGHT - 3) & F.col("c").between(2, WIDTH - 3)
    return tables.ratio_bands(spark, path, inside, GRID, ["b1", "b2"]).select("r", "c", r6("b1").alias("b1"), r6("b2").alias("b2"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN 0.65::DOUBLE * (coalesce(okey, 0) % 256) / 255 + 0.35::DOUBLE * (n % 256) / 255 ELSE 0 END')} AS value FROM lat"))
def scarp_field(spark, sf_dir):
    """Three weighted bands, of which the third is missing and the first stands in for it."""
    path, df = _bytes_raster(spark, sf_dir)
    raw = spark.read.parquet(f"{path}/cells")
    return tables.scarp(raw, df.select("r", "c", "foot"), F.col("foot")).select("r", "c", r6("value").alias("value"))


@query(sql(f"SELECT l.r, l.c, {n6('CASE WHEN foot THEN m.px::FLOAT::DOUBLE ELSE 0 END')} AS cond FROM lat l JOIN fillq f ON f.r = l.r AND f.c = l.c JOIN m ON m.r = f.s.fr AND m.c = f.s.fc", NEAREST.format(has="foot AND okey % 3 > 0 AND px IS NOT NULL")))
def conductivity(spark, sf_dir):
    """Raw values with sentinels for holes, filled from the nearest cell, never clipped."""
    path = _place(spark, "conductivity")
    df = view(spark, sf_dir)
    raster.write_raster(df, ["score"], GRID, path, F.col("foot"))
    held = F.col("foot") & F.coalesce(F.col("okey") % 3 > 0, F.lit(False)) & F.col("px").isNotNull()
    cells = df.select("r", "c", F.when(held, F.col("px")).otherwise(F.lit(raster.NODATA)).cast("float").alias("cond"), F.lit(0).alias("tr"), F.lit(0).alias("tc"))
    cells.write.mode("overwrite").partitionBy("tr", "tc").parquet(f"{path}/cells")
    inside = F.col("r").between(2, HEIGHT - 3) & F.col("c").between(2, WIDTH - 3)
    return tables.conductivity(spark, path, inside, GRID, "cond").select("r", "c", r6(F.col("cond").cast("double")).alias("cond"))


@query(sql(f"SELECT r, c, {n6('CASE WHEN foot THEN least(greatest(v, q0), q1) ELSE 0 END')} AS px FROM fl, (SELECT quantile_cont(v, 0.001) AS q0, quantile_cont(v, 0.999) AS q1 FROM fl WHERE foot)", NEAREST.format(has="dot AND px IS NOT NULL"), "fl AS (SELECT l.r, l.c, l.foot, m.px AS v FROM lat l JOIN fillq f ON f.r = l.r AND f.c = l.c JOIN m ON m.r = f.s.fr AND m.c = f.s.fc)"))
def bands_filled(spark, sf_dir):
    """A band as a model reads it: holes filled, drawn to quantiles of the footprint, 0 outside."""
    df = view(spark, sf_dir).select("r", "c", "foot", F.when(F.col("dot"), F.col("px")).alias("px"))
    return tables.bands_filled(df, ["px"], F.col("foot")).select("r", "c", r6("px").alias("px"))


@query(sql("SELECT count(*) AS cells, count(*) FILTER (foot) AS inside, count(*) FILTER (cat) AS marked FROM lat"))
def locked_inputs(spark, sf_dir):
    """Footprint and labels from a sample and a label band; a label outside of the footprint would raise."""
    df = view(spark, sf_dir)
    raw = df.select("r", "c", F.when(F.col("foot"), F.col("score")).otherwise(F.lit(float("nan"))).alias("sample"), F.when(~F.col("foot"), -1).when(F.col("cat"), 1).otherwise(0).alias("label"))
    out = tables.labels(raw, "label", "sample")
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("foot"), 1)).alias("inside"), F.count(F.when(F.col("cat"), 1)).alias("marked"))


@query(sql("""SELECT 'valid:px' AS what, NULL::INT AS value, count(px) AS n FROM lat WHERE r % 8 = 0 AND c % 8 = 0 UNION ALL SELECT 'valid:tax', NULL, count(tax) FROM lat WHERE r % 8 = 0 AND c % 8 = 0 UNION ALL SELECT 'label', cat::INT, count(*) FROM lat GROUP BY cat"""))
def profile_raster(spark, sf_dir):
    """A quick look: valid cells on a coarse grid, which is the feature, and counts of labels on all."""
    return tables.profile(view(spark, sf_dir).withColumn("label", F.col("cat").cast("int")), ["px", "tax"], "label")


@query(sql("SELECT r, c, round(score::FLOAT::DOUBLE, 6) AS score FROM lat WHERE r BETWEEN 40 AND 99 AND c BETWEEN 10 AND 29"))
def raster_box(spark, sf_dir):
    """A box of a raster: tiles that don't meet it are not read."""
    path = _place(spark, "tiles")
    raster.write_raster(view(spark, sf_dir), ["score"], GRID, path, F.col("foot"), "zeros", 32)
    return raster.read_raster(spark, path, ["score"], GRID, (40, 99, 10, 29), 32).select("r", "c", F.round(F.col("score").cast("double"), 6).alias("score"))


# -- sinks ----------------------------------------------------------------------------


@query(sql("""SELECT block, sum(bits)::BIGINT AS bits, sha256(from_hex(string_agg(hex_, '' ORDER BY r))) AS sha256 FROM (
  SELECT r, r // 64 AS block, sum(n) AS bits, string_agg(lpad(hex(v), 2, '0'), '' ORDER BY k) AS hex_ FROM (SELECT r, c // 8 AS k, sum(off::INT * (1 << (c % 8)))::INT AS v, count(*) FILTER (off) AS n FROM lat GROUP BY 1, 2) GROUP BY r) GROUP BY block"""))
def mask_digest(spark, sf_dir):
    return sinks.mask_digest(view(spark, sf_dir), F.col("off")).select("block", "bits", "sha256")


@query("SELECT o_orderpriority AS name, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1")
def report_round_trip(spark, sf_dir):
    """A report as JSON, read again."""
    path = _place(spark, "report")
    t = L.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    sinks.write_report(t, path)
    return spark.read.schema(t.schema).json(path)


@query(sql("SELECT (r >= 179)::INT AS fold, count(*) AS cells, count(*) FILTER (truth) AS truth FROM lat GROUP BY 1"))
def fold_progress(spark, sf_dir):
    """Folds recorded one by one; the second of them twice, of which the last counts."""
    path = _place(spark, "progress")
    df = view(spark, sf_dir)
    for fold in (0, 1, 1):
        part = df.filter((F.col("r") >= 179).cast("int") == fold).agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("truth"), 1)).alias("truth"))
        sinks.record_progress(part, path, fold)
    return sinks.read_progress(spark, path, "fold int, cells long, truth long")


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written_at FROM events")
def run_stamps(spark, sf_dir):
    t = L.table(spark, sf_dir, "events")
    return sinks.stamped(t, F.col("ts")).select("event_id", "run_id", "written_at")
