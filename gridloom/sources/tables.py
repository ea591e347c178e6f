"""Point and segment tables from CSV, with the rules by which rows count, and rasters with the rules of their kind."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distance import distance, nearest_fill
from ..operators.stencil import two_scale
from .lattice import first_per_key, points_to_cells, to_number
from .raster import Grid, read_grid, read_raster, same_grid


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all fields as text: what is no number is told apart later, row by row."""
    return spark.read.csv(path, header=True, inferSchema=False, comment="#", mode="PERMISSIVE")


def first_readable(spark: SparkSession, paths: list[str], read=read_text_csv) -> DataFrame:
    """The first of several places that is there; raises where none is."""
    for path in paths:
        try:
            return read(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise ValueError(f"none of {paths} is there")


def finite_number(x: str) -> Column:
    v = to_number(F.col(x))
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def heat_flow(raw: DataFrame, grid: Grid, kinds: tuple[str, ...] = ("Point",), codes: tuple[str, ...] = ("A", "B", "C"), lo: float = 20.0, hi: float = 400.0) -> DataFrame:
    """(r, c, points, value): mean of wells in a cell.

    raw: kind, unique_id, x, y, value, code as text. Rows of other kinds or
    codes and rows without numbers don't count; of an id the first row by
    (x, y, value) counts, and a row without an id is known by its place;
    values are drawn to lo and hi.
    """
    v = raw.select("kind", "unique_id", "code", *(finite_number(x).alias(x) for x in ("x", "y", "value")))
    good = v.filter(F.col("kind").isin(*kinds) & F.col("code").isin(*codes) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("value").isNotNull())
    key = F.when(F.trim("unique_id") != "", F.trim("unique_id")).otherwise(F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string")))
    one = first_per_key(good.select(F.coalesce(key, F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))).alias("key"), "x", "y", "value"), ["key"], ["x", "y", "value"])
    r, c = grid.cell(F.col("x"), F.col("y"))
    drawn = F.least(F.greatest(F.col("value"), F.lit(lo)), F.lit(hi))
    return points_to_cells(one.select(r.alias("r"), c.alias("c"), drawn.alias("value")), "r", "c", "value", None, grid.height, grid.width)


def stress(raw: DataFrame, grid: Grid, least: float = 200.0) -> DataFrame:
    """(r, c, points, value, azimuth): per cell the length-weighted mean of a ratio and of an axis, from the middles of segments of at least so many metres.

    raw: x0, y0, x1, y1, value, azimuth, length as text. Axes are averaged by
    doubled angles.
    """
    v = raw.select(*(finite_number(x).alias(x) for x in ("x0", "y0", "x1", "y1", "value", "azimuth", "length"))).dropna()
    v = v.filter(F.col("length") >= least)
    r, c = grid.cell((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    w, twice = F.col("length"), F.radians(2 * F.col("azimuth"))
    per = v.withColumns({"r": r, "c": c}).filter(F.col("r").between(0, grid.height - 1) & F.col("c").between(0, grid.width - 1)).groupBy("r", "c")
    sums = per.agg(F.count(F.lit(1)).alias("points"), (F.sum(F.col("value") * w) / F.sum(w)).alias("value"), F.sum(F.sin(twice) * w).alias("__s"), F.sum(F.cos(twice) * w).alias("__c"))
    return sums.select("r", "c", "points", "value", F.pmod(F.degrees(F.atan2("__s", "__c")) / 2, F.lit(180.0)).alias("azimuth"))


def wells(raw: DataFrame, grid: Grid, lo: float = 20.0, hi: float = 400.0, hot_from: float = 65.0) -> DataFrame:
    """(r, c, temperature, hot) per row; raises where rows and columns disagree with coordinates in more than 5 rows and 1 %.

    raw: row, col, x, y, t1, t2, t3, class as text. temperature: the most of
    the three thermometers that lie within lo and hi. hot: a class that begins
    so, or a temperature of at least hot_from.
    """
    v = raw.select(*(finite_number(x).alias(x) for x in ("row", "col", "x", "y", "t1", "t2", "t3")), F.lower(F.trim("class")).alias("class")).filter("row IS NOT NULL AND col IS NOT NULL")
    r, c = grid.cell(F.col("x"), F.col("y"))
    v = v.withColumn("__off", F.coalesce((F.abs(r - F.col("row")) > 1) | (F.abs(c - F.col("col")) > 1), F.lit(False)))
    n, off = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("__off"), 1))).first()
    if off > max(5, 0.01 * n):
        raise ValueError(f"{off} of {n} rows lie elsewhere than their coordinates")
    sane = lambda x: F.when(F.col(x).between(lo, hi), F.col(x))
    t = F.greatest(sane("t1"), sane("t2"), sane("t3"))
    hot = F.coalesce(F.col("class").startswith("hot"), F.lit(False)) | F.coalesce(t >= hot_from, F.lit(False))
    return v.select(F.bround("row", 0).cast("int").alias("r"), F.bround("col", 0).cast("int").alias("c"), t.alias("temperature"), hot.alias("hot"))


def fault_traces(raw: DataFrame, grid: Grid, inside: tuple[str, ...], ages: tuple[str, ...]) -> DataFrame:
    """(r, c, points, value): length-weighted mean slip rate per cell of the traces whose flag and age count; lengths below 1 count as 1.

    raw: row, col, rate, length, flag, age as text.
    """
    v = raw.select(*(finite_number(x).alias(x) for x in ("row", "col", "rate", "length")), F.lower(F.trim("flag")).alias("flag"), F.lower(F.trim("age")).alias("age"))
    good = v.filter(F.col("flag").isin(*(x.lower() for x in inside)) & F.col("age").isin(*(x.lower() for x in ages)) & F.col("row").isNotNull() & F.col("col").isNotNull())
    return points_to_cells(good.withColumn("w", F.greatest(F.coalesce("length", F.lit(1.0)), F.lit(1.0))), "row", "col", "rate", "w", grid.height, grid.width)


def gridded(cells: DataFrame, dense: DataFrame, value: str, weight: str, sigma: float, wide: float) -> DataFrame:
    """A sparse table of cells spread over a dense lattice by two smooths."""
    joined = dense.select("r", "c").join(cells.select("r", "c", F.col(value).alias("__x"), F.col(weight).cast("double").alias("__k")), ["r", "c"], "left")
    return two_scale(joined, "__x", "__k", sigma, wide).select("r", "c", "filled")


def proximity(dense: DataFrame, tables: list[DataFrame], sigma: float = 6.0) -> DataFrame:
    """(r, c, value): exp(-d**2 / (2 sigma**2)) of the distance to the nearest point of several tables (row, col as text, cut to whole numbers); 0 without points."""
    points = reduce(DataFrame.unionByName, [t.select(finite_number("row").cast("int").alias("r"), finite_number("col").cast("int").alias("c")) for t in tables]).dropna().distinct()
    marked = dense.select("r", "c").join(points.withColumn("marked", F.lit(True)), ["r", "c"], "left")
    return distance(marked, F.col("marked").isNotNull()).select("r", "c", F.coalesce(F.exp(-F.col("d2") / (2 * sigma * sigma)), F.lit(0.0)).alias("value"))


def load_all(dense: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """dense with a column per layer; (r, c, value) tables, joined one after the other; what a layer lacks stays null."""
    out = dense
    for name, t in layers.items():
        out = out.join(t.select("r", "c", F.col("value").alias(name)), ["r", "c"], "left")
    return out


# -- rasters -----------------------------------------------------------------------


def ratio_bands(spark: SparkSession, path: str, foot: Column, like: Grid, bands: list[str]) -> DataFrame:
    """Bands of bytes as 0 to 1, 0 outside of the footprint; raises on another grid, a missing band or another type than whole numbers of 0 to 255."""
    same_grid(read_grid(spark, path), like)
    raw = spark.read.parquet(f"{path}/cells")
    kinds = {f.name: f.dataType.simpleString() for f in raw.schema}
    wrong = [b for b in bands if kinds.get(b) not in ("tinyint", "smallint", "int")]
    if wrong:
        raise ValueError(f"no bands of bytes: {wrong}")
    off = raw.agg(*(F.count(F.when(~F.col(b).between(0, 255), 1)).alias(b) for b in bands)).first()
    if any(off):
        raise ValueError(f"values beyond a byte: {off.asDict()}")
    return raw.select("r", "c", *(F.when(foot, F.col(b) / 255.0).otherwise(0.0).alias(b) for b in bands))


def conductivity(spark: SparkSession, path: str, foot: Column, like: Grid, band: str) -> DataFrame:
    """(r, c, band): raw values, holes filled from the nearest cell that has one, never clipped, 0 outside of the footprint."""
    raw = read_raster(spark, path, [band], like)
    filled = nearest_fill(raw, band, "__f")
    return filled.select("r", "c", F.when(foot, F.col("__f")).otherwise(0.0).alias(band))


def scarp(raw: DataFrame | None, dense: DataFrame, foot: Column, b1: str = "b1", b2: str = "b2", b5: str = "b5") -> DataFrame:
    """(r, c, value): 0.45 b1 + 0.35 b2 + 0.20 b5 of bytes over 255, b1 where there is no b5; 0 outside of the footprint, and all 0 without the raster."""
    if raw is None:
        return dense.select("r", "c", F.lit(0.0).alias("value"))
    last = b5 if b5 in raw.columns else b1
    field = (0.45 * F.col(b1) + 0.35 * F.col(b2) + 0.2 * F.col(last)) / 255.0
    made = raw.select("r", "c", field.alias("__f"))
    return dense.join(made, ["r", "c"], "left").select("r", "c", F.when(foot, F.coalesce("__f", F.lit(0.0))).otherwise(0.0).alias("value"))


def bands_filled(df: DataFrame, bands: list[str], foot: Column, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """(r, c, bands): holes filled from the nearest cell, values drawn to two quantiles of the footprint, 0 outside."""
    from ..operators.normalise import quantile_row

    out = df
    for b in bands:
        out = nearest_fill(out, b, f"__f_{b}")
    q = F.broadcast(quantile_row(out, {f"__{s}_{b}": (f"__f_{b}", at) for b in bands for s, at in (("lo", lo), ("hi", hi))}, foot))  # one row
    drawn = lambda b: F.least(F.greatest(F.col(f"__f_{b}"), F.col(f"__lo_{b}")), F.col(f"__hi_{b}"))
    return out.crossJoin(q).select("r", "c", *(F.when(foot, drawn(b)).otherwise(0.0).alias(b) for b in bands))


def labels(raw: DataFrame, band: str, sample: str) -> DataFrame:
    """(r, c, foot, cat): foot where the sample is finite, cat where the label is 1 or more; raises where a label lies outside of the footprint."""
    finite = F.col(sample).isNotNull() & ~F.isnan(sample)
    out = raw.select("r", "c", finite.alias("foot"), F.coalesce(F.col(band) >= 1, F.lit(False)).alias("cat"))
    off = out.filter("cat AND NOT foot").count()
    if off:
        raise ValueError(f"{off} labels outside of the footprint")
    return out


def profile(raw: DataFrame, bands: list[str], label: str, every: int = 8) -> DataFrame:
    """(what, value, n): valid cells of each band on every so many rows and columns (the feature of a quick look), and how often each label occurs on all cells."""
    few = raw.filter((F.col("r") % every == 0) & (F.col("c") % every == 0))
    valid = few.agg(*(F.count(F.when(F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")), 1)).alias(b) for b in bands))
    rows = valid.select(F.explode(F.array(*(F.struct(F.lit(f"valid:{b}").alias("what"), F.lit(None).cast("int").alias("value"), F.col(b).alias("n")) for b in bands))).alias("x")).select("x.*")
    return rows.unionByName(raw.groupBy(F.col(label).cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("what"), "value", "n"))
