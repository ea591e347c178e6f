"""Total orders over tables of any size: ranges first, places within them, and sums over all that comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

_PLACES = 33  # fixed value: bits of monotonically_increasing_id that count rows within a partition


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df with part and at: the range of a row in the order of keys, and its place from 0 in that range.

    Ranges follow the data's size and hold whole stretches of the order, also
    of equal values where the keys tell rows apart. The result is written
    once: a second run of the sampling could cut the ranges elsewhere.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return settle(dealt, "ordered").withColumns({"part": F.shiftright("__id", _PLACES), "at": F.col("__id").bitwiseAND(F.lit((1 << _PLACES) - 1))}).drop("__id")


def _before(per: DataFrame) -> DataFrame:
    """(part, before, total): sums over the ranges before, and over all; one row per range."""
    return per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))


def numbered(df: DataFrame, place: str, total: str | None = None) -> DataFrame:
    """Of an ordered table: place, from 0 over the whole of it, and total, its number of rows."""
    before = _before(df.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    out = df.join(F.broadcast(before), "part").withColumn(place, F.col("before") + F.col("at"))  # a row per range
    return out.withColumnRenamed("total", total).drop("part", "at", "before") if total else out.drop("part", "at", "before", "total")


def running(df: DataFrame, value: Column, below: str, total: str) -> DataFrame:
    """Of an ordered table: below, the sum of value over all rows before; total, that over all."""
    before = _before(df.groupBy("part").agg(F.sum(value).alias("n")))
    own = F.sum(value).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("__own", F.coalesce(own, F.lit(0))).join(F.broadcast(before), "part")
    return out.withColumn(below, F.col("before") + F.col("__own")).withColumnRenamed("total", total).drop("part", "at", "before", "__own")
