"""Spatial blocks and holdouts of whole components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stats
from .distance import dilate
from .ordered import ordered, running


def uniform_block(height: int, width: int, rows: int, cols: int) -> Column:
    """Number, row by row, of the block of a cell; edges are the floors of equal parts."""
    cut = lambda size, n, x: sum((F.when(F.col(x) >= int(size * i / n), 1).otherwise(0) for i in range(2, n)), F.when(F.col(x) >= int(size / n), 1).otherwise(0)) if n > 1 else F.lit(0)
    return cut(height, rows, "r") * cols + cut(width, cols, "c")


def quantile_block(df: DataFrame, where: Column, rows: int, cols: int) -> DataFrame:
    """df with block: edges are quantiles of the coordinates of the domain's cells."""
    cut = lambda x, n: F.expr(f"percentile({x}, array({', '.join(repr(i / n) for i in range(1, n))}))")
    edges = F.broadcast(df.filter(where).agg(cut("r", rows).alias("er"), cut("c", cols).alias("ec")))  # one row
    below = lambda e, x: F.size(F.filter(e, lambda v: v <= F.col(x)))
    return df.crossJoin(edges).withColumn("block", below("er", "r") * cols + below("ec", "c")).drop("er", "ec")


def prefix_to(df: DataFrame, size: str, order: list, target: Column, by: list[str] = ()) -> DataFrame:
    """The least prefix that reaches target, with the row that crosses it. Without by, the order is one over ranges; a group of by is ordered in one task."""
    if not by:
        return running(ordered(df, *order), F.col(size), "__before", "__all").filter(F.col("__before") < target).drop("__before", "__all")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("__before") < target).drop("__before")


def hide(labelled: DataFrame, block: Column, share: float, seed: int) -> DataFrame:
    """(comp, block, size): components hidden in each block: a seeded order, until their cells reach share of the block's.

    A component belongs to the block of its centroid, truncated. The order is
    that of a hash of seed and first cell, so it doesn't depend on how the
    components were found.
    """
    s = stats(labelled).withColumns({"r": F.floor("mean_r").cast("int"), "c": F.floor("mean_c").cast("int")}).withColumn("block", block)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("comp").cast("string")))
    total = F.sum("size").over(Window.partitionBy("block"))
    return prefix_to(s.withColumns({"key": key, "total": total}), "size", ["key"], F.col("total") * share, ["block"]).select("comp", "block", "size")


def domains(cells: DataFrame, labelled: DataFrame, hidden: DataFrame, collar: int) -> DataFrame:
    """cells with truth (of a hidden component) and known (of a visible one, or within collar steps of it)."""
    truth = labelled.join(hidden.select("comp"), "comp", "left_semi").select("r", "c", F.lit(True).alias("truth"))
    seen = dilate(labelled.join(hidden.select("comp"), "comp", "left_anti"), collar).select("r", "c", F.lit(True).alias("known"))
    out = cells.join(truth, ["r", "c"], "left").join(seen, ["r", "c"], "left")
    return out.withColumns({"truth": F.coalesce("truth", F.lit(False)), "known": F.coalesce("known", F.lit(False))})


def prevalence_match(labelled: DataFrame, target: int, seed: int, least: int = 6) -> DataFrame:
    """Whole components of at least so many cells, in a seeded order, until target cells are reached."""
    big = stats(labelled).filter(F.col("size") >= least)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("comp").cast("string")))
    return prefix_to(big.withColumn("key", key), "size", ["key"], F.lit(target)).select("comp", "size")


def alignment(blocks: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer block: how many inner blocks it touches, and whether it lies in one."""
    return blocks.groupBy(outer).agg(F.countDistinct(inner).alias("folds")).withColumn("aligned", F.col("folds") == 1)


def annulus_holdout(cells: DataFrame, labelled: DataFrame, matched: Column, height: int, width: int, rows: int = 4, cols: int = 6, seeds: tuple[int, ...] = (31, 32), share: float = 0.25, erode: int = 6, collar: int = 10) -> DataFrame:
    """(instrument, seed, block, r, c, truth) of the active cells of every fold of two instruments.

    cells: the footprint; labelled: (r, c, comp) of the catalogue; matched: a
    condition for the second instrument's truth. A fold is the interior of a
    block, its cells at least erode away from the block's rim. The first
    instrument hides whole components: of those that have a cell in the block
    and none in the annulus (within collar steps of the block, outside of its
    interior), in a seeded order, until share of their cells is hidden; truth
    are hidden cells of the interior, and what is known is not active. The
    second one keeps the whole catalogue known, and its truth is matched.
    Blocks are equal parts, so all of this is arithmetic on coordinates: only
    catalogue cells meet the table of blocks.
    """
    spark = cells.sparkSession
    cut = lambda n, k: [int(n * i / k) for i in range(k + 1)]
    er, ec = cut(height, rows), cut(width, cols)
    boxes = F.broadcast(spark.createDataFrame([(i * cols + j, er[i], er[i + 1] - 1, ec[j], ec[j + 1] - 1) for i in range(rows) for j in range(cols)], "block int, r0 int, r1 int, c0 int, c1 int"))  # a row per block
    beyond = lambda x, lo, hi: F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0))
    inner = F.col("r").between(F.col("r0") + erode, F.col("r1") - erode) & F.col("c").between(F.col("c0") + erode, F.col("c1") - erode)
    steps = beyond("r", "r0", "r1") + beyond("c", "c0", "c1")
    marks = labelled.select("r", "c", "comp").join(cells.select("r", "c"), ["r", "c"], "left_semi")
    near = marks.join(boxes, F.col("r").between(F.col("r0") - collar, F.col("r1") + collar) & F.col("c").between(F.col("c0") - collar, F.col("c1") + collar)).withColumns({"steps": steps, "inner": inner})
    per = near.groupBy("block", "comp").agg(F.max(F.col("steps") == 0).alias("within"), F.max((F.col("steps") <= collar) & ~F.col("inner")).alias("touches")).filter("within AND NOT touches")
    sizes = marks.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    drawn = per.join(sizes, "comp").withColumn("seed", F.explode(F.lit(list(seeds))))
    key = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("block").cast("string"), F.col("comp").cast("string")))
    total = F.sum("size").over(Window.partitionBy("seed", "block"))
    hidden = prefix_to(drawn.withColumns({"key": key, "total": total}), "size", ["key"], F.col("total") * share, ["seed", "block"]).select("seed", "block", "comp", F.lit(True).alias("hidden"))
    live = cells.withColumn("matched", F.coalesce(matched, F.lit(False))).select("r", "c", "matched").withColumn("block", uniform_block(height, width, rows, cols))
    live = live.join(boxes, "block").filter(inner).drop("r0", "r1", "c0", "c1").join(marks, ["r", "c"], "left")
    first = live.withColumn("seed", F.explode(F.lit(list(seeds)))).join(F.broadcast(hidden), ["seed", "block", "comp"], "left").filter("comp IS NULL OR hidden")  # components of single folds
    second = live.filter("comp IS NULL").withColumn("seed", F.explode(F.lit(list(seeds))))
    out = lambda df, name, truth: df.select(F.lit(name).alias("instrument"), "seed", "block", "r", "c", truth.alias("truth"))
    return out(first, "I1", F.coalesce("hidden", F.lit(False))).unionByName(out(second, "I2", F.col("matched")))
