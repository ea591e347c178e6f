"""Comparing and checking cell sets and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


def overlap(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Per named set of b: common cells, Jaccard, and containment both ways; a is one set, b has a name column."""
    size = F.broadcast(a.agg(F.count(F.lit(1)).alias("n_a")))  # one row
    marked = b.join(a.select("r", "c", F.lit(1).alias("in_a")), ["r", "c"], "left")
    per = marked.groupBy(name).agg(F.count(F.lit(1)).alias("n_b"), F.count("in_a").alias("common")).crossJoin(size)
    return per.withColumns({"jaccard": F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")), "a_in_b": F.col("common") / F.col("n_a"), "b_in_a": F.col("common") / F.col("n_b")})


def unique_gate(overlaps: DataFrame, most_jaccard: float = 0.5, most_contained: float = 0.9, most_ratio: float = 10.0) -> DataFrame:
    """passes: the overlap is below both limits; a much larger reference set contains anything, so its containment doesn't count."""
    counts = (F.col("n_b") <= most_ratio * F.col("n_a"))
    return overlaps.withColumn("passes", (F.col("jaccard") < most_jaccard) & ((F.col("a_in_b") < most_contained) | ~counts))


def nested(base: DataFrame, pruned: DataFrame, near_mask: DataFrame) -> DataFrame:
    """One row: sizes, cells only in pruned (none if it is a subset), removed cells, and those of them near the mask."""
    b, p = base.select("r", "c").withColumn("b", F.lit(1)), pruned.select("r", "c").withColumn("p", F.lit(1))
    both = b.join(p, ["r", "c"], "full").join(near_mask.select("r", "c", F.lit(1).alias("m")), ["r", "c"], "left")
    return both.agg(F.count("b").alias("n_base"), F.count("p").alias("n_pruned"), F.count(F.when(F.col("b").isNull(), 1)).alias("added"), F.count(F.when(F.col("p").isNull(), 1)).alias("removed"), F.count(F.when(F.col("p").isNull() & F.col("m").isNotNull(), 1)).alias("removed_near"))


def format_audit(raster: DataFrame, value: str, foot: Column, height: int, width: int) -> DataFrame:
    """One row per check of a raster's cells, in one pass: (check, ok, found)."""
    v = F.col(value)
    inside, bad = foot, v.isNull() | F.isnan(v)
    one = raster.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(F.when(inside & bad, 1)).alias("not_finite_inside"),
        F.count(F.when(inside & ((v < 0) | (v > 1)), 1)).alias("out_of_range"),
        F.count(F.when(~inside & ~bad & (v != 0), 1)).alias("nonzero_outside"),
        F.count(F.when(inside & (v > 0), 1)).alias("positive"),
        F.count(F.when((F.col("r") < 0) | (F.col("r") >= height) | (F.col("c") < 0) | (F.col("c") >= width), 1)).alias("off_grid"),
    )
    wanted = {"cells": F.col("cells") == height * width, "not_finite_inside": F.col("not_finite_inside") == 0, "out_of_range": F.col("out_of_range") == 0, "nonzero_outside": F.col("nonzero_outside") == 0, "positive": F.col("positive") > 0, "off_grid": F.col("off_grid") == 0}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), ok.alias("ok"), F.col(k).alias("found")) for k, ok in wanted.items())))
    return one.select(rows.alias("x")).select("x.*")


def digest(cells: DataFrame, value: str, rows: int = 1024) -> DataFrame:
    """One row per block of rows: SHA-256 of its values in order; equal rasters have equal digests, and no task holds all."""
    block = F.floor(F.col("r") / rows)
    line = cells.groupBy("r").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("c", F.col(value).cast("string").alias("v")))), lambda x: F.concat_ws(":", x["c"].cast("string"), x["v"]))), 256).alias("h"))
    return line.groupBy(block.alias("block")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"])), 256).alias("sha256"))


def same_cells(rasters: DataFrame, name: str, value: str) -> DataFrame:
    """Pairs of names whose marked cells are the same: grouped by count and two sums of hashes, then each compared cell by cell with the first of its group."""
    h = F.xxhash64("r", "c")
    cells = rasters.filter(F.col(value) > 0).select(name, "r", "c").distinct()
    prints = cells.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
    groups = prints.groupBy("n", "x", "s").agg(F.min(name).alias("first"), F.collect_list(name).alias("names")).filter(F.size("names") > 1)
    pairs = settle(groups.select("first", F.explode("names").alias("other"), "n").filter("first <> other"), "equal_prints")
    one = pairs.join(cells.withColumnRenamed(name, "first"), "first")
    both = one.join(cells.withColumnRenamed(name, "other"), ["other", "r", "c"], "left_semi")
    return both.groupBy("first", "other", "n").agg(F.count(F.lit(1)).alias("shared")).filter("shared = n").drop("shared")


def forensics(rasters: DataFrame, known: DataFrame, name: str, reach: int = 8) -> DataFrame:
    """Per named raster: marked cells, those on known cells, within 2 and 3 of them, their mean distance where that is at most reach, and the median spacing of its own cells (of those with another within reach)."""
    from ..functions.kernels import offsets
    from .distance import near, spread

    close = near(known, reach).select("r", "c", "d")
    marked = rasters.select(name, "r", "c").join(close, ["r", "c"], "left")
    own = spread(rasters.select(name, "r", "c"), [(i, j, x) for i, j, x in offsets(reach) if x > 0], ["dr", "dc", "d2"]).groupBy(name, "r", "c").agg(F.min("d2").alias("own"))
    both = marked.join(own, [name, "r", "c"], "left")
    return both.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("d") == 0, 1)).alias("on_known"),
        F.count(F.when(F.col("d") <= 2, 1)).alias("within_2"),
        F.count(F.when(F.col("d") <= 3, 1)).alias("within_3"),
        F.avg("d").alias("mean_distance"),
        F.expr("percentile(own, 0.5)").alias("median_spacing"),
    )
