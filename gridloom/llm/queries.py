"""The opN_<name> queries: each applies its operator to the whole of its table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, kd_means, line_dedup, minhash, mixing, packing, period_runs, pq, quality, sharding, suffix_dedup, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, stays="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    dealt = sharding.shards(docs, "size", count=8)
    return dealt.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "vote_sum", "posterior", "score", "accepted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(table(spark, sf_dir, "pages"), "html", "page_id", "url")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; with h = crc32(doc_id) and h % 10 = 0, the words from a on repeat with period p (see the contract of op12)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    chosen = chosen.withColumn("n", F.when(F.size("words") > 0, F.size("words")))  # null where nothing is planted
    chosen = chosen.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn("rest", F.col("n") - F.col("a"))
    root = F.slice("words", F.col("a") + 1, (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(root, F.ceil(F.col("rest") / F.size(root)).cast("int"))), F.lit(1), F.col("rest")))
    return chosen.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_exact_dedup, op4_quality, op5_suffix_dedup, op6_sharding, op7_toxicity, op8_html, op9_minhash, op10_embedding_pq, op11_line_dedup, op12_period_runs, op13_kd_means)}
