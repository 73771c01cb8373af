"""Key buckets (32-bit FNV-1a over UTF-8 bytes) and round-robin ownership. Only for parity reports: Spark's own exchange deals rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed values of 32-bit FNV-1a.
OFFSET, PRIME, MASK = 2166136261, 16777619, 4294967295


def bucket(key: Column, n: int = 64) -> Column:
    """All of it stays in Catalyst: a fold over the hex digits of the key's bytes."""
    text = F.hex(F.encode(F.coalesce(key, F.lit("")), "utf-8"))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("bigint")
    h = F.aggregate(at, F.lit(OFFSET).cast("bigint"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(PRIME)).bitwiseAND(F.lit(MASK)))
    return (h % n).cast("int")


def member_order(members: DataFrame) -> DataFrame:
    """worker and place: workers (worker, join_seq) in the order they joined, from 0. There are as many rows as workers."""
    return members.select("worker", (F.row_number().over(Window.orderBy("join_seq", "worker")) - 1).alias("place"))


def owners(spark: SparkSession, n_units: int, members: int | DataFrame, unit: str = "bucket") -> DataFrame:
    """Unit u belongs to the worker whose place in join order is u mod n. members: their number (the owner is then a place), or a table (worker, join_seq)."""
    units = spark.range(n_units).withColumnRenamed("id", unit)
    if isinstance(members, int):
        return units.select(unit, F.pmod(unit, F.lit(members)).alias("owner"))
    place = member_order(members)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return units.join(F.broadcast(place.withColumn("_n", n)), F.pmod(unit, F.col("_n")) == F.col("place")).select(unit, F.col("worker").alias("owner"))


def restore_owned(state: DataFrame, owned: list[int], n: int = 64, key: str = "key") -> DataFrame:
    """State rows whose key's bucket is owned."""
    return state.where(bucket(F.col(key), n).isin(owned))
