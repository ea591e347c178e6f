"""Nearest neighbours at any distance, by buckets that grow until the neighbours found are certain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def nearest(points: DataFrame, k: int, start: int = 4) -> DataFrame:
    """(r, c, place, nr, nc, d2): the k nearest other points of each point, by squared distance, then row, then column.

    Points are cells; repeated ones count once. Fewer than k rows only where
    there are fewer other points.

    A point looks into its bucket and the eight around it. What it finds
    within a bucket's side is certain; if that is less than k, it looks again
    in buckets of twice the side. Points that look again are thin: fewer than
    k others stand within the last side, so though the buckets hold four times
    as many cells, a quarter of the points remains where the others are dense.
    A lone point far from all others is settled in as many rounds as its
    distance has binary digits.
    """
    if k < 1 or start < 1:
        raise ValueError("k and start must be positive")
    cells = settle(points.select(F.col("r").cast("long"), F.col("c").cast("long")).distinct(), "neighbour_points")
    low, high, left, right = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    open_, side, found = cells, start, None
    while low is not None:
        bucket = lambda x, s=side: F.floor(F.col(x) / s)
        homes = cells.select(F.col("r").alias("nr"), F.col("c").alias("nc"), bucket("r").alias("br"), bucket("c").alias("bc"))
        near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        looks = open_.withColumn("br", F.explode(F.transform(near, lambda i: i + bucket("r")))).withColumn("bc", F.explode(F.transform(near, lambda j: j + bucket("c"))))
        d2 = (F.col("r") - F.col("nr")) * (F.col("r") - F.col("nr")) + (F.col("c") - F.col("nc")) * (F.col("c") - F.col("nc"))
        pairs = looks.join(homes, ["br", "bc"]).withColumn("d2", d2).filter("d2 > 0")
        whole = side > max(high - low, right - left)  # all points are in reach
        if not whole:
            pairs = pairs.filter(F.col("d2") <= side * side)
        of = Window.partitionBy("r", "c")
        ranked = pairs.withColumn("place", F.row_number().over(of.orderBy("d2", "nr", "nc"))).filter(F.col("place") <= k)
        ranked = settle(ranked.select("r", "c", F.col("place").cast("int"), "nr", "nc", "d2"), "neighbours")
        done = ranked.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("r", "c")
        sure = ranked if whole else ranked.join(done, ["r", "c"], "left_semi")
        found = sure if found is None else found.unionByName(sure)
        if whole:
            break
        open_ = settle(open_.join(done, ["r", "c"], "left_anti"), "neighbours_open")
        if not open_.limit(1).count():
            break
        side *= 2
    if found is None:
        return cells.select("r", "c", F.lit(0).alias("place"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(0).cast("long").alias("d2")).limit(0)
    return found
