"""Exact deduplication [native].

Rows are grouped by a 128-bit hash of their text; inside a group the bytes
themselves are compared, so a collision of hashes never merges two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stays: str = "min") -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256 of its group of identical texts.

    stays: "min" keeps the smallest id of each group, "max" the largest. A null
    text counts as empty. Ids are compared as numbers; a null id never stays
    where another id exists, and a group of null ids has keep_id null and all
    its rows kept. Rows that repeat an id and a text are all kept or all
    dropped. Other columns pass through untouched; columns of the input named
    like a result are replaced. An empty table gives an empty table.

    Plan: (1) one scan; partial aggregation by (hash, text) merges copies
    before anything is shuffled, so a group that holds a third of all rows
    sends one row per task; the text is the grouping key, which is the
    comparison of bytes. (2) A slim table with a row per group. (3) Each row
    finds its group by hash, or by hash and text where a hash has two texts.
    """
    own = {"keep_id", "group_size", "kept", "text_sha256"}
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*(own - {text, doc_id})).withColumn("__hash", F.unhex(F.md5(body.cast("binary"))))
    best = F.min if stays == "min" else F.max
    groups = (
        rows.groupBy("__hash", body.alias("__text"))
        .agg(best(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__hash", "keep_id", "group_size", F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"))
        .groupBy("__hash")
        .agg(F.count(F.lit(1)).alias("__texts"), *(F.max(c).alias(c) for c in ("keep_id", "group_size", "text_sha256")))
    )
    groups = keep(groups, "exact_groups")
    alone = groups.filter("__texts = 1").drop("__texts")
    found = rows.join(alone, "__hash")
    clash = groups.filter("__texts > 1").select("__hash")
    if clash.limit(1).count():
        shared = rows.withColumn("__text", body).join(clash, "__hash", "left_semi")
        by_text = shared.groupBy("__hash", "__text").agg(best(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.sha2(F.first("__text").cast("binary"), 256).alias("text_sha256"))
        found = found.unionByName(shared.join(by_text, ["__hash", "__text"]).drop("__text"))
    same = F.col(doc_id).eqNullSafe(F.col("keep_id"))
    return found.withColumn("kept", same).drop("__hash")
