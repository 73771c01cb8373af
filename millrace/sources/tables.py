"""The driver's events table as Event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pin_utc

PARTITIONS = 6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_events(raw: DataFrame) -> DataFrame:
    """Columns of schema.EVENT; ts has no zone and counts as UTC."""
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("key"),
        "event_type",
        F.col("value").alias("amount"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read(pin_utc(spark), sf_dir, "events"))
