"""Incremental import: files that arrive are fingerprinted and matched once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stocktake.functions.hashing import crc32
from stocktake.operators.match import assigned


def arriving(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of (file, size, digest) of the files that appear below ``path``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.md5("content").alias("digest"), crc32(F.col("content")).alias("crc"))


def import_stream(files: DataFrame, items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Match every batch against the items that earlier batches left, and append the outcome to ``out``.

    ``items``: rom, size, digest. A batch is written under its own number, so one
    that is repeated after a failure replaces its first attempt.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        open_items, known = items, items
        try:
            done = spark.read.parquet(out).where((F.col("batch") < number) & F.col("rom").isNotNull())
            open_items = items.join(done.select("rom"), "rom", "left_anti")
        except Exception as error:  # nothing was imported yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        found = assigned(df.select("file", "size", "digest"), open_items)
        seen = known.select("size", "digest").distinct().withColumn("_known", F.lit(True))
        found = found.join(df.select("file", "size", "digest"), "file").join(seen, ["size", "digest"], "left")
        state = F.when((F.col("state") == "invalid") & F.col("_known"), "duplicate").otherwise(F.col("state"))
        found.select("file", "rom", state.alias("state")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
