"""Sharding (operator 3): vector bin packing. Groups of equal texts are placed where the dot product of their (bytes, tokens, rows) with the shards' residual capacity is highest.

It works at any size with bounded driver state. Groups above 1 / LARGE of all bytes, tokens or rows (3 * LARGE at most) are placed one by one, the largest first; smaller ones in BUNDLES bundles of whole
groups of like size and shape. A group stays whole by default, whatever its size; with cut = c one that would fill over c shards is placed in CELLS parts, so that no group of
copies upsets the balance. imbalance() reports what the placement comes to.
Rows of groups above 1 / HOT of all rows are dealt to CELLS cells by a number of their own, so neither a group of copies nor one repeated or null id is one task's work. Slots are the cells'
offsets plus the place in the cell, so numbering needs no global sort.
Null texts count as empty (size 1, crc 0); repeated rows get slots of their own; an empty table gives no rows; doc_id may have any type with an order, and other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import stage

BUNDLES, LARGE, HOT, CELLS = 8192, 32_768, 2048, 16
#: Of bytes, tokens and rows. Bytes count most, since their balance is the law that holds.
WEIGHTS = np.array([3.0, 1.0, 1.0])


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit. sizes: rows of (bytes, tokens, rows); they are taken as shares, the largest first."""
    total = np.maximum(sizes.sum(0), 1)
    v = sizes / total * WEIGHTS
    left = np.tile(WEIGHTS / shards, (shards, 1))
    out = np.zeros(len(v), np.int64)
    for k in np.lexsort((np.arange(len(v)), -v.sum(1))):
        out[k] = s = int(np.argmax(left @ v[k]))
        left[s] -= v[k]
    return out


def measured(docs: DataFrame, tokens: Column | None) -> DataFrame:
    """Narrow rows: all that later steps need of a text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.coalesce((words if tokens is None else tokens).cast("bigint"), F.lit(0)).alias("tokens"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"))


def level(x: Column, bounds: list[float]) -> Column:
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def assign(docs: DataFrame, shards: int = 8, tokens: Column | None = None, cut: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot. Law: bytes, tokens and rows of the shards are near equal, as far as whole groups allow or, with cut, in any case.
    tokens: each row's number of tokens, such as a column that operator 4 has made; default: its words."""
    spark = docs.sparkSession
    rows = stage(measured(docs, tokens), "sharding")
    sums = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(*sums).first()
    all_of = {c: max(total[c] or 0, 1) for c in ("bytes", "tokens", "rows")}
    groups = rows.groupBy("h1", "h2").agg(*sums)
    large = groups.where(" or ".join(f"{c} * {LARGE}L > {n}L" for c, n in all_of.items())).orderBy("h1", "h2").collect()  # 3 * LARGE at most
    listed, first = [], BUNDLES
    for g in large:
        parts = CELLS if g.rows * HOT > all_of["rows"] or cut is not None and max(g[c] / n for c, n in all_of.items()) > cut / shards else 1
        listed.append((g.h1, g.h2, first, parts, cut is not None and max(g[c] / n for c, n in all_of.items()) > cut / shards))
        first += parts
    listed = spark.createDataFrame(listed, "h1 bigint, h2 bigint, at bigint, parts int, cut boolean")
    # small groups: sixteen classes of size and of tokens a byte, against the average, so that bundles differ in shape
    mean, dense = all_of["bytes"] / all_of["rows"], all_of["tokens"] / all_of["bytes"]
    kind = 4 * level(F.col("size"), [mean / 2, mean, 2 * mean]) + level(F.col("tokens") / F.col("size"), [0.9 * dense, dense, 1.1 * dense])
    bundle = kind * (BUNDLES // 16) + F.pmod("h1", F.lit(BUNDLES // 16))
    cell = F.when(F.col("at").isNull(), bundle).otherwise(F.col("at") + F.pmod(F.xxhash64("row"), F.col("parts")))
    dealt = rows.join(F.broadcast(listed), ["h1", "h2"], "left").withColumn("cell", cell.cast("bigint"))
    unit = F.when(F.col("at").isNull() | F.col("cut"), F.col("cell")).otherwise(F.col("at"))
    cells = dealt.groupBy("cell", unit.alias("unit")).agg(*sums).collect()  # BUNDLES + 3 * LARGE + CELLS * (HOT + shards / cut) at most
    cells.sort(key=lambda c: c.cell)
    at = {u: k for k, u in enumerate(sorted({c.unit for c in cells}))}
    sizes = np.zeros((len(at), 3))
    for c in cells:
        sizes[at[c.unit]] += (c.bytes, c.tokens, c.rows)
    shard = place(sizes, shards)
    used, table = [0] * shards, []
    for c in cells:
        s = int(shard[at[c.unit]])
        table.append((c.cell, s, used[s]))
        used[s] += c.rows
    places = spark.createDataFrame(table, "cell bigint, shard int, first bigint")
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "row"))
    return dealt.join(F.broadcast(places), "cell").select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first") + inside - 1).cast("bigint").alias("slot"))


def imbalance(placed: DataFrame, shards: int = 8) -> DataFrame:
    """One row: by how much the fullest shard exceeds an equal share of bytes, tokens and rows (0: not at all)."""
    per = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    return per.agg(*((F.max(c) * shards / F.sum(c) - 1).alias(c) for c in ("bytes", "tokens", "rows")))
