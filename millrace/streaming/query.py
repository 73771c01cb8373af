"""The streaming query: windowed aggregate under a watermark, sinks that publish once (staged) or at least once (direct), finalizer and idle flush for windows still open, supervisor."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.windows import LATENESS_MS, combine_types
from . import commit

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for a streaming query, so that its settings touch no one else: state in RocksDB with changelogs, which isn't held in memory, and as many state partitions as asked for.
    That number stays with the query's checkpoint for good: choose it for the state that is to come (default: that of the session)."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        with contextlib.suppress(Exception):
            own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if state_partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return own


def aggregate(events: DataFrame, size_ms: int, lateness_ms: int = LATENESS_MS, ts: str = "event_time") -> DataFrame:
    """Per (window, key, type), in append mode: only plain values are kept in state, which so stays readable. ts: the column that windows follow (event time, or for processing time the ingest time)."""
    return (
        events.withColumn("at", F.timestamp_millis(ts)).withWatermark("at", f"{lateness_ms} milliseconds")
        .groupBy(F.window("at", f"{size_ms} milliseconds").alias("w"), "key", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    )


def to_rows(by_type: DataFrame, size_ms: int, checkpoint_id: int) -> DataFrame:
    return combine_types(by_type, size_ms).withColumn("checkpoint_id", F.lit(checkpoint_id).cast("bigint"))


def offsets_of(spark: SparkSession, checkpoint: str, epoch: int) -> dict[str, int]:
    """Next offset of each partition as of an epoch, from the query's offset log; empty for sources without partitions. With several topics a partition's name has its topic."""
    if not commit.exists(spark, f"{checkpoint}/offsets/{epoch}"):
        return {}
    out: dict[str, int] = {}
    for line in commit.read_text(spark, f"{checkpoint}/offsets/{epoch}").split("\n")[2:]:
        try:
            o = json.loads(line)
        except ValueError:
            continue
        if not isinstance(o, dict):
            continue
        topics = {t: v for t, v in o.items() if isinstance(v, dict) and "offset" not in v}
        for t, parts in topics.items():
            out |= {p if len(topics) == 1 else f"{t}-{p}": n for p, n in parts.items() if isinstance(n, int)}
        out |= {p: v["offset"] if isinstance(v, dict) else v for p, v in o.items() if p.isdigit() and p not in topics}
    return out


def publish(rows: Callable[[int], DataFrame], spark: SparkSession, base: str, epoch: int, offsets: dict[str, int], snapshots: dict[str, str] | None = None, fault: Callable[[int], None] | None = None) -> int | None:
    """Stages an epoch's rows (made for a commit id) in a folder of this attempt and commits them; without rows nothing is published. An epoch that runs again keeps its id. Returns the id."""
    with commit.lock(base):
        cid = commit.id_of_epoch(spark, base, epoch) or commit.next_id(spark, base)
        rel, seen = f"epoch={epoch}/attempt={uuid.uuid4().hex}", Observation()
        rows(cid).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/{rel}")
        if not seen.get["n"]:
            commit.remove(spark, f"{base}/{rel}")
            return None
        if fault:
            fault(epoch)
        commit.write_manifest(spark, base, cid, [rel], offsets, snapshots, epoch)
        return cid


def sink(base: str, checkpoint: str, size_ms: int, fault: Callable[[int], None] | None = None, mode: str = "staged", worker: str = "worker-0", compact_every: int | None = None) -> Callable[[DataFrame, int], None]:
    """mode staged: rows count from their commit on, once. direct: rows are appended to <base>/<worker> at once and count as they are there; an epoch that runs again comes again.
    compact_every: after so many commits the older ones are rolled up, so that readers plan with few files however long the query runs.
    fault, for tests, is called between the files and their manifest."""

    def by_type(batch: DataFrame) -> DataFrame:
        return batch.withColumn("window_start", F.unix_millis("w.start"))

    def staged(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cid = publish(lambda cid: to_rows(by_type(batch), size_ms, cid), spark, base, epoch, offsets_of(spark, checkpoint, epoch), {"0": f"{checkpoint}/state/0@{epoch + 1}"}, fault)
        if cid and compact_every and cid % compact_every == 0:
            commit.compact(spark, base)

    def direct(batch: DataFrame, epoch: int) -> None:
        rows = to_rows(by_type(batch), size_ms, 0).persist()
        try:
            if not rows.isEmpty():
                rows.write.mode("append").parquet(f"{base}/{worker}")
                if fault:
                    fault(epoch)
        finally:
            rows.unpersist()

    return {"staged": staged, "direct": direct}[mode]


def start(events: DataFrame, base: str, checkpoint: str, size_ms: int, lateness_ms: int = LATENESS_MS, trigger: dict | None = None, fault: Callable[[int], None] | None = None, mode: str = "staged", worker: str = "worker-0", ts: str = "event_time", compact_every: int | None = None) -> StreamingQuery:
    """A restart with the same checkpoint goes on from its offsets, state and watermark. events should come from a session() of the query's own."""
    return (
        aggregate(events, size_ms, lateness_ms, ts).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(sink(base, checkpoint, size_ms, fault, mode, worker, compact_every)).start()
    )


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The last micro-batch that has ended."""
    return max((int(n) for n in commit.names(spark, f"{checkpoint}/commits") if n.isdigit()), default=None)


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Open windows by key and type as of the last micro-batch that has ended."""
    return _by_place(spark.read.format("statestore").option("batchId", last_batch(spark, checkpoint)).load(checkpoint))


def finalize(spark: SparkSession, base: str, checkpoint: str, size_ms: int) -> int | None:
    """Publishes the windows left in state as the next commit. State stays: if the query goes on, these windows come again under later commits and first-wins hides them.
    A repeat on the same state replaces what it published before. Returns the commit's id."""
    batch = last_batch(spark, checkpoint)
    if batch is None:
        return None
    return publish(lambda cid: to_rows(state(spark, checkpoint), size_ms, cid), spark, base, -batch - 1, offsets_of(spark, checkpoint, batch), {"0": f"{checkpoint}/state/0@{batch + 1}"})


def _by_place(s: DataFrame) -> DataFrame:
    """State columns have the names that the planner gave them; their order is that of the query."""
    k, v = s.select("key.*").columns, s.select("value.*").columns
    at = lambda side, n: F.col(f"{side}.`{n}`")
    return s.select(F.unix_millis(at("key", k[0])["start"]).alias("window_start"), at("key", k[1]).alias("key"), at("key", k[2]).alias("event_type"),
                    *(at("value", n).alias(a) for n, a in zip(v, ("n", "s", "lo", "hi"), strict=True)))


def pending(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a micro-batch was planned that hasn't ended."""
    planned = max((int(n) for n in commit.names(spark, f"{checkpoint}/offsets") if n.isdigit()), default=-1)
    return planned > (-1 if (done := last_batch(spark, checkpoint)) is None else done)


def run_bounded(events: DataFrame, base: str, checkpoint: str, size_ms: int, lateness_ms: int = LATENESS_MS) -> None:
    """All that is there now, then the finalizer. A source that can't tell what is there now may end with the batch that a crash left behind, so then it is started once more."""
    spark = events.sparkSession
    again = pending(spark, checkpoint)
    start(events, base, checkpoint, size_ms, lateness_ms).awaitTermination()
    if again:
        start(events, base, checkpoint, size_ms, lateness_ms).awaitTermination()
    finalize(spark, base, checkpoint, size_ms)


class IdleFlush(threading.Thread):
    """Beside a running query: after so many ticks in which its watermark hasn't moved, windows still open are published, as partial as they are. If they close later, first-wins keeps what was
    published first, so it is for streams that end or pause, and off unless started. The same state is published once."""

    def __init__(self, q: StreamingQuery, spark: SparkSession, base: str, checkpoint: str, size_ms: int, ticks: int = 3, tick_s: float | None = None):
        super().__init__(daemon=True)
        self.q, self.to, self.ticks, self.tick_s = q, (spark, base, checkpoint, size_ms), ticks, size_ms / 1000 if tick_s is None else tick_s
        self.flushes, self.done = 0, threading.Event()

    def run(self) -> None:
        idle, last, flushed = 0, None, None
        while not self.done.wait(self.tick_s) and self.q.isActive:
            p = self.q.lastProgress
            if not p:
                continue
            now = dict(p["eventTime"]).get("watermark")
            idle, last = (idle + 1, last) if now == last else (0, now)
            if idle >= self.ticks:
                idle, batch = 0, last_batch(self.to[0], self.to[2])
                if batch != flushed and finalize(*self.to) is not None:
                    self.flushes += 1
                flushed = batch

    def stop(self) -> None:
        self.done.set()
        self.join()


def supervise(make: Callable[[], StreamingQuery], attempts: int = 5, pause_s: float = 0.0) -> int:
    """Restarts a query that failed until it ends well; returns the number of restarts."""
    for n in range(attempts):
        try:
            make().awaitTermination()
            return n
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(pause_s)
    return attempts


def progress(p) -> dict:
    """Rows in, rate, duration, rows behind the watermark, and the watermark, of one micro-batch's progress."""
    return {"batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond, "duration_ms": dict(p.durationMs).get("triggerExecution", 0),
            "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "watermark": dict(p.eventTime).get("watermark")}


class Progress(StreamingQueryListener):
    """Keeps the progress of the last micro-batches."""

    def __init__(self, keep: int = 1000):
        self.seen: list[dict] = []
        self.keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen = [*self.seen, progress(event.progress)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
