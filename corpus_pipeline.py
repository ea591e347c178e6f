"""A corpus pipeline of five stages; each one's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, exact_dedup, minhash, mixing, packing, quality
from gridloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.score_quality(docs.select(COLUMNS)).filter("accepted").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest id."""
    return exact_dedup.exact_dedup(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Documents without words stay."""
    docs = docs.select(COLUMNS)
    gone = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all. Documents are taken whole."""
    docs = docs.select(COLUMNS)
    taken = mixing.mix(docs, whole=True).filter("taken > 0")
    times = taken.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.max(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) == F.col("__tie"))
    return docs.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the signatures or the packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = common.keep_at(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last:
            common.discard(spark, last)  # the stage before is written, and its own input no longer read
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
