"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from millrace.functions import parse
from millrace.functions.windows import windowed_agg
from millrace.plans.queries import QUERIES
from millrace.session import build
from millrace.sources import generator, topic
from millrace.streaming import commit, query

NAMES = ["tumbling_window_agg", "stream_tumbling_window_agg", "closed_windows", "key_rollup", "committed_dedup", "late_events", "watermark_progress", "snapshot_history", "verify_report", "latency_histogram", "latency_quantiles", "key_bucket", "json_roundtrip"]
#: The published run's input: events, keys, window in ms, seed, events a second of event time.
DRAIN = {"total": 300_000, "keys": 500, "seed": 7, "eps": 100_000}


def drain(spark: SparkSession) -> dict:
    """A pre-loaded backlog of JSON records through the streaming query, to the last committed window. Start-up of the query is told apart: until its first batch begins."""
    root = tempfile.mkdtemp(prefix="millrace-bench-")
    try:
        src = f"file://{root}/topic"
        topic.write_topic(generator.generate(spark, **DRAIN), src)
        took = []
        for k in range(2):  # the first run warms up
            own, base, ckpt = query.session(spark, 6), f"file://{root}/out{k}", f"file://{root}/ckpt{k}"
            began = time.time()
            q = query.start(parse.decode(own.readStream.schema("value string, partition int").format("text").load(src)), base, ckpt, 1000)
            q.awaitTermination()
            batches = sum(p["durationMs"]["triggerExecution"] for p in q.recentProgress) / 1000
            query.finalize(own, base, ckpt, 1000)
            took.append((time.time() - began, batches))
        n = commit.committed(spark, base).agg(F.sum("count")).first()[0]
        assert n == DRAIN["total"], n
        return {"events": n, "sec": round(took[1][0], 3), "batches_sec": round(took[1][1], 3), "events_per_sec": round(n / took[1][0]), "events_per_sec_in_batches": round(n / took[1][1]), "batch_job_sec": batch(spark, src)}
    finally:
        shutil.rmtree(root, ignore_errors=True)


def batch(spark: SparkSession, src: str) -> float:
    """The same records by one batch job."""
    began = time.time()
    windowed_agg(topic.read_topic(spark, src), 1000).write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    d, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tumbling_window_agg"](spark, d).write.format("noop").mode("overwrite").save()  # starts the session
    drained = drain(spark)  # and the streaming engine
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{d}/events.parquet").count()
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1], "events": n,
                      "events_per_sec": {k: round(n / took[k]) for k in ("tumbling_window_agg", "stream_tumbling_window_agg")}, "drain": drained}))
    spark.stop()


if __name__ == "__main__":
    main()
