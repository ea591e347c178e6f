"""Samples of an exact size: the rows with the smallest hashes, found by histograms of the hash and not by a sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Rows of a bucket of the histogram, about: so many of a group are ranked in one task.
BUCKET = 1000
#: Bits of the hash that fold_samples counts by.
FOLD_BITS = 16


def _digit(rows: int) -> Callable[[Column], Column]:
    """The leading bits of a 60-bit hash, so many that a bucket holds about BUCKET of the rows."""
    bits = min(20, max(4, (rows // BUCKET).bit_length()))
    return lambda h: F.shiftright(h, 60 - bits)


def _hash(seed: Column | int, keys: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), *keys), 4)


def print_of(seed: int, keys: list[str]) -> Column:
    """60 bits of the md5 of seed and keys, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, 15), 16, 10).cast("long")


def _cuts(hist: DataFrame, by: list[str], size: Column) -> DataFrame:
    """by, last and left: the bucket in which a group's size is reached, and how many of it are taken. Groups that have fewer rows have no cut."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("digit"))
    return hist.withColumn("upto", upto).filter((F.col("upto") - F.col("n") < size) & (F.col("upto") >= size)).select(*by, F.col("digit").alias("last"), (size - F.col("upto") + F.col("n")).alias("left"))


def _taken(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Of rows with __h, digit, last and left: all before the cut, and the first of its bucket; ties of the hash by the keys."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__h", *keys))
    edge = rows.filter("digit = last").withColumn("__place", place).filter("__place <= left").drop("__place")
    return rows.filter("last IS NULL OR digit < last").unionByName(edge).drop("digit", "last", "left", "__h")


def exact_sample(df: DataFrame, group: str, size: int | Column, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly size rows of each group, or all where it has fewer: without replacement, the same on any partitioning.

    group must hold no nulls; keys name a row. size may be a column of group.
    A group may hold all rows: it is counted by buckets of the hash, and only
    the bucket in which the size is reached is ranked.
    """
    size = F.lit(size) if isinstance(size, int) else size
    digit = _digit(df.count())
    rows = df.filter(size > 0).withColumn("__h", print_of(seed, keys)).withColumn("digit", digit(F.col("__h")))
    hist = rows.groupBy(group, "digit").agg(F.count(F.lit(1)).alias("n"))
    cuts = settle(_cuts(hist, [group], size), "sample_cuts")
    return _taken(rows.join(cuts, group, "left"), [group], keys)


def fold_samples(df: DataFrame, unseen: Column, pool: Column, folds: list[int], seeds: list[int], sizes: Callable[[dict[str, int]], dict[str, int]], keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """df's rows by fold, seed and pool: for each fold and seed an exact sample of each pool, out of the rows that the fold may see.

    unseen: the folds that must not learn from a row (array<int>); pool: its
    name, null for rows that nobody learns from; sizes: from the rows of each
    pool that a fold may see to the rows it takes (no entry: none).

    A row has one hash; a seed says where on the circle of hashes its sample
    begins. So one read of the table counts the buckets of all folds and seeds
    (a row per set of unseen folds, pool and bucket), and another one takes
    the rows, which are copied to folds and seeds only where a cut lets them in.
    """
    spark = df.sparkSession
    base = df.withColumns({"unseen": unseen, "pool": pool, "__h": _hash(0, list(keys))}).filter("pool IS NOT NULL").withColumn("digit", F.shiftright("__h", 60 - FOLD_BITS).cast("int"))
    hist = settle(base.groupBy("unseen", "pool", "digit").agg(F.count(F.lit(1)).alias("n")), "sample_buckets")
    allowed = F.array_except(F.lit(list(folds)), "unseen")
    buckets = 1 << FOLD_BITS
    begins = {s: (s * 0x9E3779B97F4A7C15 >> 20) % buckets for s in seeds}
    turned = lambda d, s: F.pmod(d - begins[s], F.lit(buckets)).cast("int")
    per = hist.withColumn("fold", F.explode(allowed)).groupBy("fold", "pool", "digit").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[str, int]] = {k: {} for k in folds}
    for r in per.groupBy("fold", "pool").agg(F.sum("n").alias("n")).collect():  # a row per fold and pool
        counts[r.fold][r.pool] = r.n
    wanted = [(k, p, int(n)) for k in folds for p, n in sizes(counts[k]).items() if n > 0]
    by = ["fold", "seed", "pool"]
    if not wanted:
        return base.limit(0).select(*df.columns, F.lit(0).alias("fold"), F.lit(0).alias("seed"), "pool")
    want = F.broadcast(spark.createDataFrame(wanted, "fold int, pool string, size long"))  # as many
    turns = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), turned(F.col("digit"), s).alias("digit")) for s in seeds)))
    seeded = per.withColumn("turn", turns).select("fold", "pool", "n", "turn.seed", "turn.digit").join(want, ["fold", "pool"])
    cuts = settle(_cuts(seeded, by, F.col("size")), "sample_cuts")
    # a row per pool: for each seed the last bucket that any fold takes from (all of them where a fold takes everything)
    cut_of = {(r.pool, r.seed): r["last"] for r in cuts.groupBy("pool", "seed").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).collect() if r.n == sum(p == r.pool for _, p, _ in wanted)}
    open_ = lambda s: sum((F.when((F.col("pool") == p) & (turned(F.col("digit"), s) <= cut_of.get((p, s), buckets)), 1).otherwise(0) for p in sorted({p for _, p, _ in wanted})), F.lit(0)) > 0
    first = open_(seeds[0])
    for s in seeds[1:]:
        first = first | open_(s)
    chosen = base.filter(first).withColumn("seed", F.explode(F.array_compact(F.array(*(F.when(open_(s), F.lit(s)) for s in seeds)))))
    chosen = chosen.withColumn("digit", sum((F.when(F.col("seed") == s, turned(F.col("digit"), s)).otherwise(0) for s in seeds), F.lit(0)))
    chosen = chosen.withColumn("fold", F.explode(allowed)).drop("unseen").join(want, ["fold", "pool"]).drop("size").join(F.broadcast(cuts), by, "left").filter("last IS NULL OR digit <= last")
    return _taken(settle(chosen, "fold_rows"), by, list(keys)).select(*(c for c in df.columns if c not in ("unseen", "pool")), *by)
