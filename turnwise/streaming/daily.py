"""Transcripts as a stream: counts per day and user with late rows, over folders that fill up.

The batch engine has no streaming mode to match; this carries its time buckets over to Structured Streaming. Rows later
than the watermark are dropped by Spark, repeated deliveries of an id within it count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.dates import parse_created_at
from turnwise.sources.files import KNOWN

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in KNOWN])


def read_stream(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """Parquet files of transcripts as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def daily_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """(bucket_day, telegram_user_internal_id, n) of rows with a readable time, in append mode once a day can no longer change."""
    timed = stream.withColumn("_at", parse_created_at(F.col("created_at")).cast("timestamp")).filter(F.col("_at").isNotNull())
    once = timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["id"])
    counts = once.groupBy(F.window("_at", "1 day").alias("w"), "telegram_user_internal_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("bucket_day"), "telegram_user_internal_id", "n")
