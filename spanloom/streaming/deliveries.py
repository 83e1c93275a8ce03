"""Structured Streaming over deliveries: an extension, since snapshots themselves are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deliveries(spark: SparkSession, folder: str, like: DataFrame, files_a_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, key: str = "fragment_id", time: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Each record once, redeliveries within ``late`` of it being dropped; the state older than that is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def delivery_counts(stream: DataFrame, time: str = "ingested_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Deliveries, and bytes of text, by window of time and repository."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "repository").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))


def upsert_first(batch: DataFrame, folder: str, key: str = "fragment_id") -> None:
    """``foreachBatch`` sink that adds the records a table does not have yet; a batch that comes again adds nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # Only a folder without a table is a table without rows; any failure to read one that is there is a failure.
    if system.exists(path) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        fresh = fresh.join(spark.read.schema(batch.select(key).schema).parquet(folder), key, "left_anti")
    fresh.write.mode("append").parquet(folder)
