"""What the operators share: table reads, staged tables in the folder that driver and executors share, held-out rows, Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of an Arrow batch at most: very long texts must not make a batch of gigabytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Allocators of Python workers, where the session says nothing else: blocks over 4 MB go back to the system when freed, so a worker that waits for its next task holds little.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Before Python operators: Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, where the session allows more, allocators that give memory back, and this package on the Python workers' path (on a cluster, ship it with --py-files). Plans are run after an operator has returned, so these settings stay with the session."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        with contextlib.suppress(Exception):
            now = spark.conf.get(k)
            if not now.isdigit() or int(now) <= 0 or int(now) > v:
                spark.conf.set(k, str(v))


_kept: dict[Any, Any] = {}


def trim() -> None:
    """Freed memory of this process goes back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """In a Python worker, before a task that keeps nothing: what another operator kept goes, and its memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing, so that workers that serve one operator after another don't hold the tables of all."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
        trim()
    return _kept[key]


def release_heap(spark: SparkSession) -> None:
    """Before a stage whose Python workers need memory: executors collect their garbage and give the free part of their heaps back, which JVM stages before have filled."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of our own, but only if driver and executors are one process, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        d = _own[context.applicationId]
    return d.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once to the shared folder and read back: it cuts the lineage and outlives executors. Removed by unstage, or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "_staged_at", None)) is not None:
            _remove(t.sparkSession, path)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def ascii_lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def label_sample(labels: DataFrame, column: str, per_class: dict[int, int], seed: int) -> list[tuple[str, int]]:
    """At most per_class[c] labelled doc_ids (as strings, whatever their type) of each class, chosen by a hash of the id. Ids labelled both ways count for neither."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min(column).alias("y"), F.max(column).alias("z")).where("y = z")
    out: list[tuple[str, int]] = []
    for c, n in per_class.items():
        out += [(r[0], c) for r in one.where(F.col("y") == c).select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()]
    return out


def sample_texts(docs: DataFrame, picked: list[tuple[str, int]]) -> DataFrame:
    """id, y and text of the picked documents: one row an id, so that no more come than were picked. Of several texts under one id it is that with the least hash."""
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "id string, y int"))  # as many rows as the sample's bound
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    return texts.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("m")).select("id", "y", F.col("m.t").alias("text"))


def class_share(labels: DataFrame, column: str) -> float:
    """Share of label 1 among all labels, held within 0.001 and 0.999."""
    r = labels.agg(F.avg(F.col(column).cast("double"))).first()[0]
    return min(0.999, max(0.001, 0.5 if r is None else r))


#: Rows of a list of keys up to which it is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame, weight: Column | None = None) -> DataFrame:
    """The (staged) keys, marked for broadcast if they are few enough. weight: what a row counts for, where rows hold lists."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few and weight is not None:
        few = (keys.agg(F.sum(weight.cast("bigint"))).first()[0] or 0) <= BROADCAST_ROWS
    return F.broadcast(keys) if few else keys


#: A key with more than 1 / HEAVY of all rows is heavy: at most HEAVY keys can be.
HEAVY = 1000


def spread_join(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", heavy: int = HEAVY, many: bool = False, by: DataFrame | None = None) -> DataFrame:
    """rows joined with values though single keys may hold a third of rows: the values of heavy keys are broadcast, the others meet by a shuffle.

    values has one row a key, so what is broadcast is HEAVY rows at most; with many=True it may have more, and a key whose values are over 1 / heavy of all of them isn't broadcast but
    left to the shuffle. Both sides are read several times, so they should be staged or cheap; by: a cheaper table with the keys of rows, to be counted instead.
    """
    narrow = rows if by is None else by
    counted = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col(key).isNotNull())
    total = narrow.count()
    if total <= 10 * heavy:
        return rows.join(values, key, how)
    listed = counted.where(F.col("_c") > total / heavy).select(key)
    if many:
        most = values.count() / heavy
        listed = listed.join(values.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most), key, "left_anti")
    keys = listed.collect()
    if not keys:
        return rows.join(values, key, how)
    often = F.broadcast(rows.sparkSession.createDataFrame([tuple(k) for k in keys], rows.select(key).schema))
    there = rows.join(often, key, "left_semi").join(F.broadcast(values.join(often, key, "left_semi")), key, how)
    return rows.join(often, key, "left_anti").join(values.join(often, key, "left_anti"), key, how).unionByName(there)
