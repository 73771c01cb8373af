"""A topic as a directory of JSON lines, one folder a partition, and a Kafka reader behind the same interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import decode
from ..functions.routing import bucket


def write_topic(events: DataFrame, path: str, partitions: int = 6, mode: str = "append", by: Column | None = None) -> None:
    """Events go to the partition of their key."""
    part = bucket(F.col("key"), partitions) if by is None else by
    rows = events.select(part.alias("partition"), F.to_json(F.struct(*events.columns)).alias("value"))
    rows.write.mode(mode).partitionBy("partition").text(path)


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All of a topic, as a batch."""
    return decode(spark.read.schema("value string, partition int").text(path), stamp=True, keep=("partition",))


def stream_topic(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema("value string, partition int")
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return decode(r.format("text").load(path), stamp=True, keep=("partition",))


def from_kafka(raw: DataFrame) -> DataFrame:
    """Events of the connector's rows, with their partition and offset."""
    return decode(raw.select(F.col("value").cast("string").alias("value"), "partition", "offset"), stamp=True, keep=("partition", "offset"))


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_batch: int | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path; starting (earliest or latest) counts only where there is no checkpoint."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return from_kafka((r.option("maxOffsetsPerTrigger", per_batch) if per_batch else r).load())
