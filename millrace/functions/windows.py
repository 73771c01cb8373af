"""Tumbling windows over epoch milliseconds and what follows from a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LATENESS_MS = 1000


def window_start(ts: Column, size_ms: int) -> Column:
    return ts - ts % F.lit(size_ms)


def windowed_agg(events: DataFrame, size_ms: int, ts: str = "event_time") -> DataFrame:
    """One row per (key, window): count, sum, min, max and exact distinct types.

    Types are folded first, so both levels combine before their exchange and no set of types is kept.
    """
    start = window_start(F.col(ts), size_ms)
    by_type = events.groupBy("key", start.alias("window_start"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    return combine_types(by_type, size_ms)


def combine_types(by_type: DataFrame, size_ms: int) -> DataFrame:
    """From rows per (key, window, type) to rows per (key, window)."""
    return by_type.groupBy("key", "window_start").agg(
        F.sum("n").alias("count"), F.sum("s").alias("sum_amount"), F.min("lo").alias("min_amount"),
        F.max("hi").alias("max_amount"), F.count("event_type").alias("distinct_types"),
    ).select("key", "window_start", (F.col("window_start") + size_ms).alias("window_end"), "count", "sum_amount", "min_amount", "max_amount", "distinct_types")


def watermark(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """One row: the largest event time seen less the allowed lateness."""
    return events.agg((F.max("event_time") - lateness_ms).alias("watermark"))


def split_closed(rows: DataFrame, events: DataFrame, closed: bool, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Windows that the watermark has closed (its bound included), or those still open. The watermark is one broadcast row."""
    w = F.broadcast(watermark(events, lateness_ms))
    hit = F.col("window_end") <= F.col("watermark")
    return rows.join(w, hit if closed else ~hit | F.col("watermark").isNull()).drop("watermark")


def watermark_progress(events: DataFrame, step_ms: int, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """The watermark after each step of event time. The running maximum goes over the per-step maxima, not over the events."""
    steps = events.groupBy(window_start(F.col("event_time"), step_ms).alias("step_start")).agg(F.max("event_time").alias("top"), F.count(F.lit(1)).alias("n_events"))
    run = Window.orderBy("step_start").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("step_start", "n_events", (F.max("top").over(run) - lateness_ms).alias("watermark"))


def late_events(events: DataFrame, arrival: Column, size_ms: int, block_ms: int, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Events whose window was closed by those that arrived before them.

    The running maximum over arrival order is taken in two levels: within blocks of arrival time (many tasks),
    and over the maxima of the blocks before (one row a block).
    """
    e = events.withColumn("_at", arrival).withColumn("_block", F.floor(F.col("_at") / block_ms))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = e.groupBy("_block").agg(F.max("event_time").alias("_top")).withColumn("_before", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy("_block").orderBy("_at", F.col("event_id").cast("bigint")).rowsBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("_inside", F.max("event_time").over(inside)).join(blocks, "_block")
    top = F.greatest("_before", "_inside")
    end = window_start(F.col("event_time"), size_ms) + size_ms
    return seen.where(end <= top - lateness_ms).select("event_id", "key", "event_time", (top - lateness_ms).alias("watermark"))
