"""Landing-folder ingest: a file stream in place of a push server; the batch plan converts what arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators.lookup import supported

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder, each once, with checksum and whether their kind is supported."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)
    return files.select("path", "length", F.md5("content").alias("digest"), supported(F.col("path")).alias("supported"), "content")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame], keep_original: bool = False) -> None:
    """Convert what has arrived since the last run; unsupported files, and originals to keep, are stored verbatim.

    convert: path, content to path, output, ok, message, content. Each batch writes a folder of its own, which a repeated batch replaces.
    """

    def batch(files: DataFrame, number: int) -> None:
        made = convert(files.filter("supported")).withColumn("kind", F.lit("converted"))
        kept = files.filter(~F.col("supported") | F.lit(keep_original))
        kept = kept.select("path", F.col("path").alias("output"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"), "content", F.lit("original").alias("kind"))
        made.unionByName(kept).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
