"""Reports, progress and digests: small results written by Spark, so a reader never sees half of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row; Spark's commit puts the file in place when it is whole. Reports are small: one file."""
    df.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("errorifexists").csv(path, header=True)


def record_progress(df: DataFrame, path: str, fold: int) -> None:
    """What is known of a fold, in a folder of its own that is replaced as a whole: a run that is taken up again overwrites only its own folds."""
    df.withColumn("fold", F.lit(fold)).coalesce(1).write.mode("overwrite").json(f"{path}/part={fold}")


def read_progress(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/part=*")


def stamped(df: DataFrame, when: Column | None = None) -> DataFrame:
    """df with run_id (yyyyMMddTHHmmssZ) and written_at (ISO 8601), in UTC by the session's time zone."""
    at = F.current_timestamp() if when is None else when
    return df.withColumns({"run_id": F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), "written_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")})


def mask_digest(cells: DataFrame, mask: Column, rows: int = 64) -> DataFrame:
    """(block, bits, sha256): digest of a mask by blocks of rows; each row's cells in order of columns as eight bits to a byte, the first cell the lowest bit.

    A task holds a block of rows; the digests of the blocks stand for the
    mask, and equal masks have equal ones.
    """
    bit = F.when(mask, F.lit(1)).otherwise(F.lit(0))
    byte = cells.groupBy("r", F.floor(F.col("c") / 8).alias("k")).agg(F.sum(bit * F.pow(F.lit(2), F.col("c") % 8).cast("int")).cast("int").alias("v"), F.sum(bit).alias("n"))
    line = byte.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("bytes"), F.sum("n").alias("n"))
    text = line.select("r", "n", F.concat_ws("", F.transform("bytes", lambda x: F.lpad(F.hex(x["v"]), 2, "0"))).alias("hex"))
    block = text.groupBy(F.floor(F.col("r") / rows).alias("block")).agg(F.sum("n").cast("long").alias("bits"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("r", "hex"))), lambda x: x["hex"])).alias("hex"))
    return block.select("block", "bits", F.sha2(F.unhex("hex"), 256).alias("sha256"))
