"""Reads of window rows: first-wins dedup, rollups, reports, reconciliation, snapshot history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(rows: DataFrame, order: list[str], by: tuple[str, ...] = ("key", "window_start")) -> DataFrame:
    """The first row of each (key, window) in commit order, then by its other columns; later ones are duplicates. A minimum, so that duplicates fall before the exchange."""
    rest = [c for c in rows.columns if c not in by]
    first = [c for c in order if c in rest]
    least = rows.groupBy(*by).agg(F.min(F.struct(*first, *(c for c in rest if c not in first))).alias("_r"))
    return least.select(*(F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in rows.columns))


def duplicates(rows: DataFrame, by: tuple[str, ...] = ("key", "window_start")) -> DataFrame:
    per = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"), F.count(F.lit(1)).alias("windows"))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def key_rollup(rows: DataFrame) -> DataFrame:
    """Windows folded again per key; sums in integer cents, so that the order of addition doesn't show."""
    return rows.groupBy("key").agg(
        F.sum("count").alias("count"), cents(F.sum("sum_amount")).alias("sum_cents"), F.min("min_amount").alias("min_amount"), F.max("max_amount").alias("max_amount"))


def rollup_lines(rollup: DataFrame) -> DataFrame:
    """One column, line: key, count, cents, min and max with two decimals, parted by tabs."""
    two = lambda c: F.format_string("%.2f", c)
    return rollup.select(F.concat_ws("\t", "key", "count", "sum_cents", two("min_amount"), two("max_amount")).alias("line"))


def rollup_tsv(rollup: DataFrame, path: str) -> None:
    """The lines by key. Sorted by range, so the parts in name order are sorted too."""
    rollup_lines(rollup.orderBy("key")).write.mode("overwrite").text(path)


def verify_report(rows: DataFrame, files: str | None = None) -> DataFrame:
    """One row: events, keys, distinct windows and duplicates, and files if a column tells where a row came from. Expects all committed rows; counts events of the first row of each window. One pass."""
    per = rows.groupBy("key", "window_start").agg(F.min(F.struct("checkpoint_id", "count")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    out = per.agg(F.coalesce(F.sum("_r.count"), F.lit(0)).alias("events"), F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return out if files is None else out.crossJoin(F.broadcast(rows.agg(F.countDistinct(files).alias("files"))))  # one row each


def rollup_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two rollups that differ, with the side they are on; none if the rollups are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def missing(base: DataFrame, other: DataFrame) -> DataFrame:
    return base.join(other, "key", "left_anti")


def lost(base: DataFrame, other: DataFrame, column: str = "count") -> DataFrame:
    """Keys for which the other side has fewer events than the baseline."""
    o = other.select("key", F.col(column).alias("_o"))
    j = base.select("key", F.col(column).alias("base_count")).join(o, "key", "left")
    return j.select("key", "base_count", F.coalesce("_o", F.lit(0)).alias("other_count")).where("other_count < base_count")


def history(rows: DataFrame, id_col: str = "checkpoint_id") -> DataFrame:
    """Snapshots oldest first with the rows that each sees. The running sum goes over one row a snapshot."""
    per = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("added_rows"))
    run = Window.orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(F.row_number().over(Window.orderBy(id_col)).alias("sequence"), id_col, "added_rows", F.sum("added_rows").over(run).alias("total_rows"))


def time_travel(rows: DataFrame, id_col: str = "checkpoint_id") -> DataFrame:
    """One row: rows as of the first snapshot, as of the last, and the difference."""
    h = history(rows, id_col)
    return h.agg(F.min_by("total_rows", "sequence").alias("first_rows"), F.max_by("total_rows", "sequence").alias("last_rows")).withColumn("difference", F.col("last_rows") - F.col("first_rows"))


def offsets(records: DataFrame) -> DataFrame:
    """Next offset to read of each partition."""
    return records.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))
