"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _settled(edges: DataFrame) -> bool:
    """Every edge leads to a root, and no id has two."""
    if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
        return False
    return not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component): every id of a link that isn't the smallest of its component, with that smallest id.

    Rounds of large stars (larger neighbours move to the smallest neighbour)
    and small stars (so do smaller ones) until all edges lead to roots; the
    number of rounds grows with the logarithm of the longest path. Links with
    a null end and of an id with itself count for nothing; an empty table
    gives an empty one. Minima are written before they are joined, so that
    Spark can split the join at an id that a third of all links share. A
    table of links is dealt to as many tasks as it has half millions of rows,
    twelve at least.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    edges = keep(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("u"), small.alias("v")).distinct(), "links")
    tasks = max(12, edges.count() // 500_000)
    few = lambda df, name: keep(df.coalesce(tasks), name)
    edges = edges.coalesce(tasks)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large_star")
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = few(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
