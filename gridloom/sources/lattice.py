"""Lattices as cell tables: one row per (r, c), one column per band or mask.

The standard lattice is made of ``lineitem``: a row is a week of shipping, a
column a quantity. Facts are aggregated once, with partial sums; what follows
works on cells, whose number does not grow with the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the standard lattice: weeks from this day on, its size, and its masks.
DAY_ZERO, HEIGHT, WIDTH = "1995-01-01", 358, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold facts: n, okey (sum of order keys), px, disc and tax (means; money in cents summed exactly)."""
    items = table(spark, sf_dir, "lineitem").select(
        F.floor(F.datediff("l_shipdate", F.lit(DAY_ZERO)) / 7).cast("int").alias("r"),
        (F.floor("l_quantity") - 1).cast("int").alias("c"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        "l_orderkey",
    )
    return items.groupBy("r", "c").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_orderkey").alias("okey"),
        (F.sum("cents") / F.count(F.lit(1)) / 100).alias("px"),
        (F.sum("disc") / F.count(F.lit(1))).alias("disc"),
        (F.sum("tax") / F.count(F.lit(1))).alias("tax"),
    )


def with_masks(df: DataFrame) -> DataFrame:
    """Adds foot (a frame of two cells is outside), cat (traces along rows) and off (one cell in 29 or so)."""
    r, c = F.col("r"), F.col("c")
    return df.withColumns({
        "foot": r.between(2, HEIGHT - 3) & c.between(2, WIDTH - 3),
        "cat": (r % 37 == 5) & c.between(5, 44),
        "off": F.coalesce(F.col("okey") % 29 == 0, F.lit(False)),
    })


def frame(spark: SparkSession, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """All (r, c) of a lattice, made where they are needed."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the standard lattice with its masks; n is 0 and the other bands are null where there are no facts."""
    return with_masks(frame(spark).join(cells(spark, sf_dir), ["r", "c"], "left")).withColumn("n", F.coalesce("n", F.lit(0)))


def wide(spark: SparkSession, sf_dir: str, height: int = 3730, width: int = 3292) -> DataFrame:
    """A lattice of any size: the line items spread over it by a hash, with the bands and masks that a fold needs.

    n, px and tax are of the facts in a cell (0 without any); score is a hash
    of the cell; foot leaves a frame of 20; cat are traces along rows, and off
    one cell in 900 or so.
    """
    h = F.xxhash64("l_orderkey", "l_linenumber")
    facts = table(spark, sf_dir, "lineitem").select(F.pmod(h, F.lit(height)).cast("int").alias("r"), F.pmod(F.shiftright(h, 20), F.lit(width)).cast("int").alias("c"), "l_extendedprice", "l_tax")
    per = facts.groupBy("r", "c").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_extendedprice").alias("px"), F.avg("l_tax").alias("tax"))
    out = frame(spark, height, width).join(per, ["r", "c"], "left").fillna(0.0, ["n", "px", "tax"])
    r, c, u = F.col("r"), F.col("c"), F.xxhash64("r", "c")
    return out.withColumns({
        "score": F.pmod(u, F.lit(1_000_003)) / 1_000_003.0,
        "foot": r.between(20, height - 21) & c.between(20, width - 21),
        "cat": (r % 37 == 5) & c.between(60, width - 61) & (F.floor(c / 150) % 2 == 0),
        "off": F.pmod(F.shiftright(u, 12), F.lit(900)) == 0,
    })


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*rest).alias("row"))
    return df.groupBy(*key).agg(F.min(ordered).alias("first")).select(*key, *(F.col(f"first.row.{c}").alias(c) for c in rest))


def to_number(text: F.Column) -> F.Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; unreadable fields become null."""
    return spark.read.schema(schema).csv(path, header=header, mode="PERMISSIVE", comment="#")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def union_first_wins(*tables: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of several ledgers; of a key that repeats, that of the first table; values "" and "NA" don't count."""
    stacked = None
    for i, t in enumerate(tables):
        t = t.select(key, F.col(value).cast("string").alias(value), F.lit(i).alias("rank"))
        stacked = t if stacked is None else stacked.unionByName(t)
    valid = stacked.filter(F.col(value).isNotNull() & ~F.trim(value).isin("", "NA"))
    return first_per_key(valid, [key], ["rank", value]).drop("rank")


def points_to_cells(points: DataFrame, row: str, col: str, value: str, weight: str | None = None, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """Weighted mean of the points that round (half to even) to each cell; points outside or without a finite value don't count."""
    w = F.col(weight) if weight else F.lit(1.0)
    placed = points.select(F.bround(row, 0).cast("int").alias("r"), F.bround(col, 0).cast("int").alias("c"), F.col(value).cast("double").alias("v"), w.cast("double").alias("w"))
    placed = placed.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1) & ~F.isnan("v") & F.col("v").isNotNull() & (F.abs("v") != float("inf")))
    return placed.groupBy("r", "c").agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("ws")).select("r", "c", "points", (F.col("vw") / F.col("ws")).alias("value"))
