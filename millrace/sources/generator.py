"""Synthetic events without per-row Python: seeded draws over a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The event types drawn.
TYPES = ["purchase", "view", "click", "refund", "add_to_cart"]


def drawn(ids: DataFrame, at: Column, keys: int, max_lateness_ms: int, seed: int) -> DataFrame:
    """Events of a column id. at: when each happens; event time is put back by up to max_lateness_ms. Key, type, amount and skew follow from the seed and the id alone."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n))
    skew = draw(4, max_lateness_ms) if max_lateness_ms > 0 else F.lit(0).cast("bigint")
    return ids.select(
        F.sha2(F.concat_ws("-", F.lit(seed), F.col("id")), 256).substr(1, 32).alias("event_id"),
        F.concat(F.lit("user_"), draw(1, keys)).alias("key"),
        F.element_at(F.array(*map(F.lit, TYPES)), (draw(2, len(TYPES)) + 1).cast("int")).alias("event_type"),
        (draw(3, 10_000) / F.lit(100.0)).alias("amount"),
        (at - skew).cast("bigint").alias("event_time"),
        F.lit(0).cast("bigint").alias("ingest_time"),
    )


def generate(spark: SparkSession, total: int, keys: int = 100, max_lateness_ms: int = 0, seed: int = 42, start_ms: int = 1_700_000_000_000, eps: int = 1000) -> DataFrame:
    """Event i happens at start + i / eps seconds."""
    return drawn(spark.range(total), F.lit(start_ms) + F.floor(F.col("id") * 1000 / eps), keys, max_lateness_ms, seed)


def stream(spark: SparkSession, eps: int = 1000, keys: int = 100, max_lateness_ms: int = 0, seed: int = 42) -> DataFrame:
    """A paced stream: eps events a second, each happening now."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", eps).load()
    return drawn(ticks.withColumnRenamed("value", "id"), F.unix_millis("timestamp"), keys, max_lateness_ms, seed)
