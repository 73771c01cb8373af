"""Latencies, histograms with exponential bounds, their interpolated quantiles, rates, and counters of a streaming query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# First bound in milliseconds and number of bounds, each twice the one before, of the two histograms; the dashboard's quantiles.
EVENT_LATENCY, CHECKPOINT_DURATION = (1, 15), (5, 12)
QUANTILES = (0.5, 0.95, 0.99)


def latency_ms(event_time: Column, now: Column) -> Column:
    """From an event's own time to when it is folded."""
    return (now - event_time).cast("double")


def bucket_bound(ms: Column, first: float, n: int) -> Column:
    """The smallest bound that isn't below the value; null beyond the last (+Inf)."""
    out = F.lit(None).cast("double")
    for b in reversed([first * 2**i for i in range(n)]):
        out = F.when(ms <= b, F.lit(float(b))).otherwise(out)
    return out


def histogram(values: DataFrame, column: str, bounds: tuple[float, int] = EVENT_LATENCY) -> DataFrame:
    """Cumulative counts by bound; at most one row a bound is ever windowed."""
    per = values.groupBy(F.coalesce(bucket_bound(F.col(column), *bounds), F.lit(float("inf"))).alias("le")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("le", "n", F.sum("n").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def quantile(hist: DataFrame, q: float, bounds: tuple[float, int] = EVENT_LATENCY) -> DataFrame:
    """Linear interpolation within the bucket that holds the q-th observation, from the bound below it, used or not; the last finite bound if that is +Inf."""
    first, n = bounds
    w = Window.orderBy("le")
    h = hist.select("le", "cumulative", F.coalesce(F.lag("cumulative").over(w), F.lit(0)).alias("below"), F.max("cumulative").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.lit(q) * F.col("total")
    hit = h.where((F.col("cumulative") >= rank) & (F.col("below") < rank))
    low = F.when(F.col("le") <= first, F.lit(0.0)).otherwise(F.col("le") / 2)
    top = float(first * 2 ** (n - 1))
    return hit.select(F.lit(q).alias("q"), F.when(F.col("le") == float("inf"), F.lit(top)).otherwise(low + (F.col("le") - low) * (rank - F.col("below")) / (F.col("cumulative") - F.col("below"))).alias("value"))


def quantiles(hist: DataFrame, qs: tuple[float, ...] = QUANTILES, bounds: tuple[float, int] = EVENT_LATENCY) -> DataFrame:
    """One row for each quantile of the dashboard."""
    return reduce(DataFrame.unionByName, (quantile(hist, q, bounds) for q in qs))


def rate(events: DataFrame, window_ms: int) -> DataFrame:
    """Events a second in each window of event time."""
    t = F.col("event_time")
    return events.groupBy((t - t % window_ms).alias("window_start")).agg(F.count(F.lit(1)).alias("n_events")).withColumn("per_second", F.col("n_events") / F.lit(window_ms / 1000.0))


def scrape(spark: SparkSession, seen: list[dict]) -> DataFrame:
    """One row of counters over the micro-batches that a streaming.query.Progress listener has seen."""
    rows = [(b["batch"], b["rows"], b["duration_ms"], b["dropped"]) for b in seen]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, duration_ms bigint, dropped bigint").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("events_consumed"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("events_late"), F.countDistinct("batch").alias("batches"),
        F.max("batch").alias("last_batch"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("busy_ms"))
