"""Sharding by a two-pass external shuffle [native].

Pass one scatters the records by seeded hashes into buckets that fit in
memory; pass two shuffles each bucket with Fisher-Yates. The buckets in order
are one random permutation of the records, which is then dealt into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Buckets that one shuffle deals at most, and up to which their offsets (16 bytes each) are broadcast; beyond, records and offsets are shuffled to meet.
WIDTH, BROADCAST_BUCKETS = 10_000, 500_000


def _told_apart(df: DataFrame, size: str, seed: int, bucket_bytes: int) -> DataFrame:
    """df with __order, the seeded hash that a record is dealt by. Records that are equal in every column and would fill a bucket are counted and laid out again with a number each, so that they spread."""
    hashed = F.xxhash64(F.lit(seed), *df.columns)
    heavy = keep(df.select(hashed.alias("__h"), F.col(size).alias("__s")).groupBy("__h").agg(F.sum("__s").alias("__s")).filter(F.col("__s") > bucket_bytes).select("__h"), "heavy_records")
    if not heavy.limit(1).count():
        return df.withColumn("__order", hashed)
    heavy = F.broadcast(heavy)  # one per bucket at most: each stands for more bytes than a bucket holds
    marked = df.withColumn("__h", hashed)
    light = marked.join(heavy, "__h", "left_anti").withColumnRenamed("__h", "__order").select(*df.columns, "__order")
    counted = marked.join(heavy, "__h", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    chunk = 100_000
    chunks = counted.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {chunk}"))))
    copies = chunks.withColumn("__k", F.explode(F.sequence(F.col("__k") * chunk, F.least(F.col("__k") * chunk + (chunk - 1), F.col("__n") - 1))))
    return light.unionByName(copies.select(*df.columns, F.xxhash64(F.lit(seed), *df.columns, "__k").alias("__order")))


def _scattered(rows: DataFrame, buckets: int, width: int, seed: int) -> DataFrame:
    """Each bucket's records in random order, bucket by bucket, written: (__bucket, __i, __row).

    A shuffle deals width buckets at most. Where there are more, the records
    are written in so many parts first, and each part is dealt on its own.
    """
    def dealt(part: DataFrame, n: int) -> DataFrame:
        return (
            part.repartition(n, "__bucket").groupBy("__bucket")
            .agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
            .sortWithinPartitions("__bucket")
            .select("__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
            .select("__bucket", F.posexplode("__rows").alias("__i", "__row"))
        )

    if buckets <= width:
        return keep(dealt(rows, buckets), "shuffled")
    parts = keep(rows.withColumn("__part", F.expr(f"__bucket div {width}").cast("int")), "scattered", "__part")
    out = None
    for k in range(-(-buckets // width)):
        done = keep(dealt(parts.filter(F.col("__part") == k).drop("__part"), min(width, buckets - k * width)), "shuffled")
        out = done if out is None else out.unionByName(done)
    return out


def shuffled(df: DataFrame, size: str, seed: int = 17, bucket_bytes: int = 32 << 20, least: int = 64, width: int = WIDTH) -> DataFrame:
    """df in random order: adds position (gapless from 0 over the whole table).

    size: a column with each record's bytes; the number of buckets follows its
    sum, so a bucket fits in memory at any input size. Records go to buckets
    by a seeded hash of all their columns, so a hot source or repeated text
    spreads like anything else; so do records that are equal in every column,
    which are interchangeable. In a bucket, records are first put in one order
    (of that hash, then all columns), so a lost task repeats itself. Nulls
    hash like values; an empty table gives an empty table; columns of the
    input named position are replaced.
    """
    df = df.drop("position") if size != "position" else df
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(least, -(-int(total) // bucket_bytes))
    told = _told_apart(df, size, seed, bucket_bytes)
    rows = told.select(F.pmod("__order", F.lit(buckets)).cast("int").alias("__bucket"), F.struct("__order", *df.columns).alias("__row"))
    pairs = _scattered(rows, buckets, width, seed)
    before = (
        pairs.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    )  # a row per bucket, not per record
    if buckets <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    return pairs.join(before, "__bucket").select((F.col("__before") + F.col("__i")).alias("position"), *(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def shards(df: DataFrame, size: str, count: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, width: int = WIDTH) -> DataFrame:
    """The shuffled records with shard (0 to count-1) and slot (gapless from 0 in each shard).

    Positions are dealt in turn, so the shards' numbers of rows differ by one
    at most, and each shard is itself a uniform random sample in random order.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    mixed = shuffled(df.drop(*({"shard", "slot"} - {size})), size, seed, bucket_bytes, width=width)
    at = F.col("position")
    return mixed.select("*", (at % count).cast("int").alias("shard"), F.floor(at / count).cast("long").alias("slot")).drop("position")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records, a folder for each shard, in order of their slots within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
