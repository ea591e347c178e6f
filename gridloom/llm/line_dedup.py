"""Line deduplication by sorted ranges of line hashes [native].

Hashes of lines are dealt into ranges and sorted by hash, document and
position; the first occurrence of each hash streams by, and what comes from a
later document is marked. What is returned for a document is a compressed
bitmap of the lines that stay, not text; applying it is a step of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep, keep_at

#: White space that is stripped from a line's ends, and code points that a key has at least.
SPACE, LEAST = "\t\n\x0b\x0c\r ", 10
#: A hash that holds one in COMMON of all lines is settled without a shuffle; counters of the sketch that finds those hashes; tasks that gather it first.
COMMON, COUNTERS, GATHER = 2000, 24_000, 64
#: Lines that a range holds on average.
RANGE_LINES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))  # lower() is the faster one, and right for ASCII


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(doc_id: str, text: str) -> Column:
    """A 128-bit print of a row's id and text: rows that share it fare alike."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _long_lines(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """hash (128 bits), prefix (its first 60 bits), doc, row and pos of each line whose key is long enough."""
    rows = docs.select(F.col(doc_id).alias("doc"), _row(doc_id, text).alias("row"), F.col(text).alias("text"))  # before the lines, so once a row
    rows = rows.select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    hashed = rows.filter(F.length(F.btrim("line", F.lit(SPACE))) >= least).withColumn("hex", F.md5(line_key(F.col("line")).cast("binary")))
    return hashed.select(F.unhex("hex").alias("hash"), F.conv(F.substring("hex", 1, 15), 16, 10).cast("long").alias("prefix"), "doc", "row", "pos")


def _common(lines: DataFrame) -> DataFrame:
    """The prefixes that stand on more than one in COMMON of all lines: 2 * COMMON rows at most.

    A sketch of frequent items names them (each task's, then each group of
    tasks', then one). It may name too many or miss one near the border: that
    moves work between the two paths of keep_bitmaps and changes no result.
    """
    sketches = lines.groupBy(F.pmod(F.spark_partition_id(), F.lit(GATHER)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(prefix, {COUNTERS})").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"), F.sum("n").alias("n"))  # by a constant: there is no sketch of nothing
    items = whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {2 * COMMON})")).alias("i"), "n")
    return items.filter(F.col("i.count") * COMMON > F.col("n")).select(F.col("i.item").alias("prefix"))


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, range_lines: int = RANGE_LINES) -> DataFrame:
    """row (print of id and text), n_dropped and keep for each document that loses a line.

    keep is a bitmap in words of 64 lines, array<struct<word, bits>> by word:
    bit i of word w tells whether line 64 * w + i stays. Words in which all
    lines stay are left out, and documents that lose nothing have no row.

    A line goes if its key (see line_key) has at least `least` code points and
    stands in a document with a smaller id. Documents without an id are taken
    as one document behind all others. Rows that repeat an id are one document.

    Plan: hashes, ids and positions are written once; ranges of equal width of
    the hash are dealt to tasks and sorted by hash, document and position, and
    a window that only looks back passes the first document on. A hash on more
    than one in COMMON of all lines would make a task's range too large: its
    smallest document comes from a partial aggregate (a row per such hash) and
    is broadcast, so its lines are never shuffled.
    """
    spark = docs.sparkSession
    lines, at = keep_at(_long_lines(docs, text, doc_id, least), "long_lines")
    ranges = int(max(12, lines.count() // range_lines))
    common = keep(_common(lines), "common_lines")
    marked = lines.join(F.broadcast(common.withColumn("often", F.lit(True))), "prefix", "left")
    firsts = keep(marked.filter("often").groupBy("hash").agg(F.min("doc").alias("first")), "common_firsts")
    later = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    often = marked.filter("often").join(F.broadcast(firsts), "hash").filter(later).select("row", "pos")
    spread = marked.filter("often IS NULL").withColumn("range", F.shiftright(F.shiftright("prefix", 30) * ranges, 30).cast("int"))
    by_hash = Window.partitionBy("range", "hash").orderBy(F.col("doc").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    rare = spread.repartitionById(ranges, F.col("range")).withColumn("first", F.first("doc").over(by_hash)).filter(later).select("row", "pos")
    words = often.unionByName(rare).groupBy("row", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    maps = words.groupBy("row").agg(F.sum(64 - F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))
    maps = keep(maps, "keep_bitmaps")
    discard(spark, at)
    return maps


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, range_lines: int = RANGE_LINES) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, keep (the bitmap, null where all lines stay) and kept_text for every row.

    A text is split at \\n; null and empty texts are one empty line. Lines that
    stay are joined by \\n as they were. Within the first document all
    occurrences of a line stay. Rows without an id lose what any document with
    an id holds, and nothing to each other. Rows that repeat an id lose nothing
    to each other. Other columns, whatever their names, are not read; an empty
    table gives an empty table.
    """
    maps = keep_bitmaps(docs, text, doc_id, least, range_lines)
    # words that were left out come back, so that a line finds its word by place
    gap = lambda e, k: e["word"] - F.coalesce(F.get("keep", k - 1)["word"], F.lit(-1)) - 1
    dense = F.flatten(F.transform("keep", lambda e, k: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(e, k)), F.array(e["bits"]))))
    maps = maps.select("row", "n_dropped", "keep", dense.alias("words"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _row(doc_id, text).alias("row"))
    stays = lambda _, i: F.coalesce(F.call_function("shiftright", F.get("words", F.call_function("shiftright", i, F.lit(6))), i % 64).bitwiseAND(F.lit(1)) == 1, F.lit(True))
    lines = _lines(F.col("text"))
    kept = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return rows.join(maps, "row", "left").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep", kept.alias("kept_text"))
