"""A versioned table: one snapshot an appended checkpoint, readable as of any snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.views import first_wins, history, time_travel
from ..schema import WINDOW_ROW
from . import commit


def append(spark: SparkSession, source: str, table: str) -> int:
    """Appends each committed checkpoint of source that the table doesn't have yet, deduplicated within itself; empty ones make no snapshot. Each reads its own files only. Returns how many were appended."""
    have = {r[0] for r in commit.ids(spark, table).toLocalIterator()}
    n = 0
    for m in commit.manifests(spark, source).toLocalIterator():
        if m.checkpoint_id in have or not m.staged_outputs:
            continue
        rows = spark.read.schema(WINDOW_ROW).parquet(*(f"{source}/{p}" for p in m.staged_outputs)).where(F.col("checkpoint_id") == m.checkpoint_id)
        rel = f"snapshot={m.checkpoint_id}/attempt={uuid.uuid4().hex}"
        first_wins(rows, ["count"], ("checkpoint_id", "key", "window_start")).write.parquet(f"{table}/{rel}")
        if spark.read.schema(WINDOW_ROW).parquet(f"{table}/{rel}").isEmpty():
            commit.remove(spark, f"{table}/{rel}")
            continue
        commit.write_manifest(spark, table, m.checkpoint_id, [rel], dict(m.kafka_offsets or {}))
        n += 1
    return n


def snapshots(spark: SparkSession, table: str) -> DataFrame:
    return history(commit.committed(spark, table))


def current(spark: SparkSession, table: str) -> int:
    return commit.latest(spark, table) or 0


def as_of(spark: SparkSession, table: str, checkpoint_id: int) -> DataFrame:
    return commit.committed(spark, table, checkpoint_id)


def report(spark: SparkSession, table: str) -> DataFrame:
    """Rows as of the first and the last snapshot, and the difference."""
    return time_travel(commit.committed(spark, table))
