import json
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from millrace import config
from millrace.functions import parse, routing, windows
from millrace.operators import metrics, views
from millrace.schema import EVENT
from millrace.sources import generator, partition_log, topic
from millrace.streaming import commit, lakehouse, query

GOLDEN = [("user_a", "purchase", 1.0, 1000), ("user_a", "view", 3.0, 4000), ("user_a", "purchase", 2.0, 9000), ("user_b", "click", 5.0, 2000), ("user_a", "purchase", 10.0, 12000), ("user_a", "purchase", 20.0, 18000)]
WANT = {("user_a", 0, 10000, 3, 6.0, 1.0, 3.0, 2), ("user_b", 0, 10000, 1, 5.0, 5.0, 5.0, 1), ("user_a", 10000, 20000, 2, 30.0, 10.0, 20.0, 1)}


def rows(df):
    return {tuple(r) for r in df.drop("checkpoint_id").collect()}


def golden(spark):
    return spark.createDataFrame([(str(i), *r, 0) for i, r in enumerate(GOLDEN)], EVENT)


def test_golden_windows(spark):
    assert rows(windows.windowed_agg(golden(spark), 10_000)) == WANT


def test_closed_bound_is_inclusive(spark):
    w = windows.windowed_agg(golden(spark), 10_000)
    e = golden(spark).withColumn("event_time", F.when(F.col("event_time") > 9000, 11000).otherwise(F.col("event_time")))
    assert {r.window_end for r in windows.split_closed(w, e, True).collect()} == {10_000}
    assert {r.window_end for r in windows.split_closed(w, e, False).collect()} == {20_000}


def test_buckets(spark):
    df = spark.createDataFrame([(f"user_{c}",) for c in "abcdef"] + [("",), (None,), ("ü",)], "key string")
    got = df.select("key", routing.bucket(F.col("key"), 4), routing.bucket(F.col("key"), 64)).collect()
    assert [tuple(r)[1:] for r in got[:6]] == [(2, 2), (3, 47), (0, 28), (1, 9), (2, 54), (3, 35)]

    def fnv(b):
        h = 2166136261
        for x in b:
            h = ((h ^ x) * 16777619) & 0xFFFFFFFF
        return h

    assert [r[2] for r in got[6:]] == [fnv(b"") % 64, fnv(b"") % 64, fnv("ü".encode()) % 64]
    assert {r[0] for r in routing.restore_owned(df.limit(6), [0, 2], 4).select("key").collect()} == {"user_a", "user_c", "user_e"}


def test_owners(spark):
    got = routing.owners(spark, 64, 3).collect()
    assert len(got) == 64 and {r.owner for r in got} == {0, 1, 2}


def test_owners_by_members(spark):
    """Three workers, 6 partitions, 64 buckets: each unit has one owner, in the order of joining, and 1000 keys all go to an owned bucket."""
    members = spark.createDataFrame([("w9", 1), ("w1", 5), ("w5", 3)], "worker string, join_seq int")
    assert [(r.worker, r.place) for r in routing.member_order(members).orderBy("place").collect()] == [("w9", 0), ("w5", 1), ("w1", 2)]
    for n, unit in ((6, "partition"), (64, "bucket")):
        got = {r[unit]: r.owner for r in routing.owners(spark, n, members, unit).collect()}
        assert got == {k: ["w9", "w5", "w1"][k % 3] for k in range(n)}
    keys = spark.range(1000).select(routing.bucket(F.concat(F.lit("user_"), F.col("id")), 64).alias("bucket"))
    assert keys.join(routing.owners(spark, 64, members), "bucket").count() == 1000


CASES = {
    '{"key":"a","amount":1.5,"event_time":3}': ("a", 1.5, 3),
    '{"KEY":"x","Amount":7,"event_time":null}': ("x", 7.0, 0),  # names in any case, null is the zero value
    '{"key":"a","KEY":"b"}': ("b", 0.0, 0),  # the last counts
    '{"extra":[1],"more":{"key":1}}': ("", 0.0, 0),
    ' {"key":"\\u00e9"}\n': ("é", 0.0, 0),
    "{}": ("", 0.0, 0),
    " null ": ("", 0.0, 0),
    **dict.fromkeys(['{"key":5}', '{"key":["a"]}', '{"amount":"x"}', '{"amount":true}', '{"amount":1e400}', '{"event_time":1.0}', '{"event_time":1e3}', '{"event_time":"3"}', '{"event_time":99999999999999999999}', "{", "", "[1]", "5", '{"key":"a"} x', '{"key":']),
}


def test_malformed_records(spark):
    bad = spark.createDataFrame([(x,) for x in [*CASES, None]], "value string")
    got = {r.value: (r.key, r.amount, r.event_time) for r in parse.decode(bad, keep=("value",)).collect()}
    assert got == {k: v for k, v in CASES.items() if v is not None}


def test_config(monkeypatch):
    for k, v in (("WINDOW_MS", "500"), ("BUCKETS", "many"), ("MODE", "direct"), ("START", "")):
        monkeypatch.setenv(f"MILLRACE_{k}", v)
    c = config.Config.from_env()
    assert (c.window_ms, c.buckets, c.lateness_ms, c.mode, c.start) == (500, 64, 1000, "direct", "earliest")


def test_histogram_bounds(spark):
    """Both histograms and their quantiles against plain Python; a bucket's lower bound counts though no value is in the bucket below."""
    ms = [0.5, 1, 3, 3.5, 40, 41, 900, 20_000, 17_000, 16_384]
    df = spark.createDataFrame([(float(x),) for x in ms], "ms double")
    for bounds in (metrics.EVENT_LATENCY, metrics.CHECKPOINT_DURATION):
        tops = [bounds[0] * 2**k for k in range(bounds[1])]
        le = sorted(next((float(t) for t in tops if t >= x), float("inf")) for x in ms)
        hist = metrics.histogram(df, "ms", bounds)
        assert [(r.le, r.cumulative) for r in hist.orderBy("le").collect()] == [(b, sum(x <= b for x in le)) for b in sorted(set(le))]
        for r in metrics.quantiles(hist, bounds=bounds).collect():
            rank, b = r.q * len(ms), next(b for b in sorted(set(le)) if sum(x <= b for x in le) >= r.q * len(ms))
            below = sum(x < b for x in le)
            low = 0 if b <= bounds[0] else b / 2
            assert r.value == pytest.approx(tops[-1] if b == float("inf") else low + (b - low) * (rank - below) / le.count(b))


def test_first_wins_needs_order(spark):
    df = spark.createDataFrame([("a", 0, 2, 9), ("a", 0, 1, 5), ("b", 0, 1, 1)], "key string, window_start bigint, checkpoint_id bigint, count bigint")
    assert {tuple(r) for r in views.first_wins(df, ["checkpoint_id"]).collect()} == {("a", 0, 1, 5), ("b", 0, 1, 1)}


def test_partitions_dont_matter(spark):
    e = generator.generate(spark, 5000, 200, 500, 99, eps=50_000)
    got = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({tuple(r) for r in views.key_rollup(windows.windowed_agg(e, 1000)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) == 200


def paths(tmp_path, *names):
    return (f"file://{tmp_path}/{x}" for x in names)


def rollup(df):
    return {tuple(r) for r in views.key_rollup(df).collect()}


def test_crash_between_files_and_manifest(spark, tmp_path):
    e = generator.generate(spark, 2000, 50, 0, 99, eps=100)
    src, base, ckpt, lake = paths(tmp_path, "topic", "out", "ckpt", "lake")
    own = query.session(spark, 2)
    for k in range(4):  # files of 5 seconds of events each
        topic.write_topic(e.where(F.floor((F.col("event_time") - 1_700_000_000_000) / 5000) == k), src)
    left = [1]

    def fault(epoch):
        if left and epoch >= 1:
            left.pop()
            raise RuntimeError("planted")

    make = lambda **k: query.start(topic.stream_topic(own, src, 6), base, ckpt, 1000, 6000, **k)
    assert query.supervise(lambda: make(fault=fault)) == 1
    assert commit.raw(spark, base).count() > commit.committed(spark, base).count() > 0  # the attempt that failed left files that don't count
    query.finalize(own, base, ckpt, 1000)
    done = commit.committed(spark, base)
    assert views.duplicates(done).first().duplicates == 0
    want = rollup(windows.windowed_agg(e, 1000))
    assert rollup(done) == want and want
    before = commit.latest(spark, base)
    make().awaitTermination()  # nothing new: nothing comes twice
    query.finalize(own, base, ckpt, 1000)  # the same state: the same commit
    assert commit.latest(spark, base) == before and views.duplicates(commit.committed(spark, base)).first().duplicates == 0
    n = lakehouse.append(spark, base, lake)
    assert n == before and lakehouse.append(spark, base, lake) == 0
    h = lakehouse.snapshots(spark, lake).collect()
    assert h[-1].total_rows == done.count() and lakehouse.current(spark, lake) == h[-1].checkpoint_id
    assert lakehouse.as_of(spark, lake, h[0].checkpoint_id).count() == h[0].total_rows
    r = lakehouse.report(spark, lake).first()
    assert (r.first_rows, r.last_rows) == (h[0].total_rows, h[-1].total_rows)
    files = views.verify_report(done.withColumn("f", F.input_file_name()), "f").first()
    assert (files.events, files.duplicates) == (2000, 0) and files.files >= before
    views.rollup_tsv(views.key_rollup(done), f"{base}-rollup")
    lines = [r.value for r in spark.read.text(f"{base}-rollup").collect()]
    assert sorted(lines) == sorted(f"{k}\t{c}\t{s}\t{lo:.2f}\t{hi:.2f}" for k, c, s, lo, hi in want)
    # rolled up: the same rows, ids and history; then the failed attempt's and the rolled-up folders go
    ids, as_of = [r[0] for r in commit.ids(spark, base).collect()], commit.committed(spark, base, 1).count()
    assert commit.compact(spark, base, keep=1) == len(ids) - 1 and commit.compact(spark, base, keep=1) == 0
    assert [r[0] for r in commit.ids(spark, base).collect()] == ids and commit.committed(spark, base, 1).count() == as_of and rollup(commit.committed(spark, base)) == want
    assert len(commit.listing(spark, base)[0]) == 1 and commit.latest(spark, base) == before
    assert commit.vacuum(spark, base) == 0 and commit.vacuum(spark, base, 0) >= len(ids)
    assert rollup(commit.committed(spark, base)) == want and [r[0] for r in commit.ids(spark, base).collect()] == ids
    assert len(commit.names(spark, f"{base}/_commits")) == 2 and commit.latest(spark, base) == before


def test_commit_folder_without_manifest(spark, tmp_path):
    """A crash during the first manifest leaves a temporary file: nothing is committed, and nothing fails."""
    base = f"file://{tmp_path}/out"
    os.makedirs(tmp_path / "out/_commits")
    (tmp_path / "out/_commits/.1-e0.json.1.tmp").write_text("{")
    assert commit.latest(spark, base) is None and commit.manifests(spark, base).count() == 0 and commit.committed(spark, base).count() == 0 and commit.next_id(spark, base) == 1
    assert commit.committed_offsets(spark, base).count() == 0
    commit.write_manifest(spark, base, 1, ["a"], {"0": 3})
    commit.write_manifest(spark, base, 1, ["b"], {"0": 4})
    assert [(r.checkpoint_id, r.staged_outputs) for r in commit.manifests(spark, base).collect()] == [(1, ["b"])]
    assert [tuple(r) for r in commit.committed_offsets(spark, base).collect()] == [(0, 4)]


def test_a_run_goes_on_after_the_finalizer(spark, tmp_path):
    """Later epochs get later ids, so what the finalizer published first stays what readers see, and the order of snapshots only grows."""
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    own = query.session(spark, 2)
    row = lambda t, a: spark.createDataFrame([("1", "k", "view", a, t, 0)], EVENT)
    topic.write_topic(row(500, 1.0), src)
    query.run_bounded(topic.stream_topic(own, src), base, ckpt, 1000)
    topic.write_topic(row(600, 2.0).unionByName(row(60_000, 4.0)), src)
    query.start(topic.stream_topic(own, src), base, ckpt, 1000).awaitTermination()
    got = sorted((r.checkpoint_id, r.window_start, r.sum_amount) for r in commit.committed(spark, base).collect())
    assert got == [(1, 0, 1.0), (2, 0, 3.0)]
    kept = views.first_wins(commit.committed(spark, base), ["checkpoint_id"]).collect()
    assert [(r.checkpoint_id, r.sum_amount) for r in kept] == [(1, 1.0)]
    assert [r.checkpoint_id for r in commit.manifests(spark, base).collect()] == [1, 2]


def test_commits_are_rolled_up_on_the_way(spark, tmp_path):
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    own = query.session(spark, 2)
    e = generator.generate(spark, 1800, 5, 0, 5, eps=100)
    for k in range(18):
        topic.write_topic(e.where(F.floor((F.col("event_time") - 1_700_000_000_000) / 1000) == k).coalesce(1), src, 1)
    query.start(topic.stream_topic(own, src, 1), base, ckpt, 1000, 0, compact_every=4).awaitTermination()
    query.finalize(own, base, ckpt, 1000)
    one, rolled = commit.listing(spark, base)
    assert len(rolled) == 1 and len(one) < 15 and commit.latest(spark, base) >= 16
    ids = [r[0] for r in commit.ids(spark, base).collect()]
    assert ids == list(range(1, len(ids) + 1)) and rollup(commit.committed(spark, base)) == rollup(windows.windowed_agg(e, 1000))
    assert views.duplicates(commit.committed(spark, base)).first().duplicates == 0


def test_direct_mode_is_at_least_once(spark, tmp_path):
    """Rows count at once; an epoch that fails after its rows and runs again comes twice; an empty batch writes nothing."""
    e = generator.generate(spark, 500, 20, 0, 5, eps=100)
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    own = query.session(spark, 2)
    topic.write_topic(e, src)
    left = [1]

    def fault(epoch):
        if left:
            left.pop()
            raise RuntimeError("planted")

    assert query.supervise(lambda: query.start(topic.stream_topic(own, src), base, ckpt, 1000, mode="direct", fault=fault)) == 1
    raw = commit.raw(spark, base)
    cents = lambda df: {(r.key, r.window_start, r["count"], round(r.sum_amount * 100)) for r in df.collect()}
    want = cents(windows.windowed_agg(e, 1000).where("window_end <= 1700000003990"))
    assert cents(raw) == want and views.duplicates(raw).first().duplicates == len(want) and not os.path.exists(tmp_path / "out/_commits")
    n = len(list((tmp_path / "out/worker-0").glob("*.parquet")))
    query.start(topic.stream_topic(own, src), base, ckpt, 1000, mode="direct").awaitTermination()
    assert len(list((tmp_path / "out/worker-0").glob("*.parquet"))) == n


def test_idle_flush_and_counters(spark, tmp_path):
    """A running query whose watermark stands still publishes its open windows once; then more events close them, and first-wins keeps one row a window."""
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    own = query.session(spark, 2)
    row = lambda t, a: spark.createDataFrame([("1", "k", "view", a, t, 0)], EVENT)
    seen = query.Progress()
    own.streams.addListener(seen)
    topic.write_topic(row(500, 1.0), src)
    q = query.start(topic.stream_topic(own, src), base, ckpt, 1000, trigger={"processingTime": "200 milliseconds"})
    flush = query.IdleFlush(q, own, base, ckpt, 1000, ticks=3, tick_s=0.3)
    flush.start()
    wait(lambda: commit.latest(spark, base) == 1)
    time.sleep(2.5)
    assert flush.flushes == 1 and [(r.window_start, r.sum_amount) for r in commit.committed(spark, base).collect()] == [(0, 1.0)]
    topic.write_topic(row(60_000, 2.0), src)
    wait(lambda: (commit.latest(spark, base) or 0) >= 2)
    flush.stop()
    q.stop()
    own.streams.removeListener(seen)
    kept = views.first_wins(commit.committed(spark, base), ["checkpoint_id"])
    assert sorted((r.window_start, r.sum_amount) for r in kept.collect())[0] == (0, 1.0)
    c = metrics.scrape(spark, seen.seen).first()
    assert c.events_consumed == 2 and c.events_late == 0 and c.batches >= 2 and c.busy_ms > 0


def wait(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end, "waited too long"
        time.sleep(0.2)


def test_processing_time_window(spark, tmp_path):
    """Windows that follow the ingest time instead of the event time."""
    e = spark.createDataFrame([("1", "k", "view", 1.0, 100, 5000), ("2", "k", "view", 2.0, 200, 9000)], EVENT)
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    e.write.parquet(src)
    own = query.session(spark, 2)
    query.start(own.readStream.schema(EVENT).parquet(src), base, ckpt, 1000, ts="ingest_time").awaitTermination()
    query.finalize(own, base, ckpt, 1000)
    assert sorted(r.window_start for r in commit.committed(spark, base).collect()) == [5000, 9000]


DRIVER = """
import sys
sys.path.insert(0, {root!r})
from millrace.functions import parse
from millrace.session import build
from millrace.sources import partition_log
from millrace.streaming import query
spark = build("killed", "2", **{{"spark.driver.memory": "1g"}})
own = query.session(spark, 2)
partition_log.register(own)
src = own.readStream.format("partition_log").option("partitions", 3).load({log!r})
query.start(parse.decode(src), {base!r}, {ckpt!r}, 1000, trigger={{"processingTime": "300 milliseconds"}}).awaitTermination()
"""


def test_killed_driver_publishes_once(spark, tmp_path):
    """The driver is killed between commits while events come in; a new one goes on from the checkpoint. Windows equal those of a batch run, none twice, and the offsets committed are those produced."""
    log, base, ckpt = (f"{tmp_path}/{x}" for x in ("log", "out", "ckpt"))
    e = generator.generate(spark, 3000, 40, 0, 99, eps=100).withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int"))
    all_rows = sorted((r.partition, r.event_time, r.event_id, r.value) for r in e.select("partition", "event_time", "event_id", F.to_json(F.struct(*EVENT.fieldNames())).alias("value")).collect())
    os.makedirs(log)

    def produce(lo, hi):
        for p in range(3):
            with open(f"{log}/{p}.log", "a") as f:
                f.writelines(v + "\n" for q, t, _, v in all_rows if q == p and lo <= t - 1_700_000_000_000 < hi)

    (tmp_path / "driver.py").write_text(DRIVER.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), log=log, base=f"file://{base}", ckpt=f"file://{ckpt}"))
    produce(0, 8000)
    run = lambda: subprocess.Popen([sys.executable, str(tmp_path / "driver.py")], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    commits = lambda: len(list((tmp_path / "out/_commits").glob("*.json"))) if (tmp_path / "out/_commits").exists() else 0
    first = run()
    try:
        wait(lambda: commits() >= 1, 90)
        produce(8000, 16_000)  # it is killed while it works on these
        time.sleep(0.4)
    finally:
        os.killpg(first.pid, signal.SIGKILL)
        first.wait()
    produce(16_000, 1 << 40)
    own = query.session(spark, 2)
    partition_log.register(own)
    src = own.readStream.format("partition_log").option("partitions", 3).load(log)
    query.run_bounded(parse.decode(src), f"file://{base}", f"file://{ckpt}", 1000)
    done = commit.committed(spark, f"file://{base}")
    assert views.duplicates(done).first().duplicates == 0
    assert {(r.key, r.window_start, r["count"], round(r.sum_amount * 100)) for r in done.collect()} == {(r.key, r.window_start, r["count"], round(r.sum_amount * 100)) for r in windows.windowed_agg(e, 1000).collect()}
    assert views.rollup_diff(views.key_rollup(done), views.key_rollup(windows.windowed_agg(e, 1000))).count() == 0
    assert sum(r.next_offset for r in commit.committed_offsets(spark, f"file://{base}").collect()) == 3000
    m = commit.manifests(spark, f"file://{base}").collect()
    assert [r.checkpoint_id for r in m] == list(range(1, len(m) + 1)) and all(r.state_snapshots for r in m)


def test_very_late_row_isnt_published_again(spark, tmp_path):
    src, base, ckpt = paths(tmp_path, "topic", "out", "ckpt")
    row = lambda t, a: spark.createDataFrame([("1", "k", "view", a, t, 0)], EVENT)
    for e in (row(500, 1.0), row(60_000, 2.0), row(600, 4.0), row(120_000, 8.0)):
        topic.write_topic(e, src)
        query.start(topic.stream_topic(spark, src), base, ckpt, 1000).awaitTermination()
    first = [r for r in commit.committed(spark, base).collect() if r.window_start == 0]
    assert [r.sum_amount for r in first] == [1.0]


def test_partition_log(spark, tmp_path):
    partition_log.register(spark)
    for p in range(2):
        (tmp_path / f"{p}.log").write_text("".join(f'{{"key":"k{i}é"}}\n' for i in range(3 + p)) + '{"key":"torn')
    df = spark.read.format("partition_log").option("partitions", "3").load(str(tmp_path))  # a partition without a file is empty
    assert sorted((r[0], r[1]) for r in views.offsets(df).collect()) == [(0, 3), (1, 4)]

    def drain(name, start):
        q = (spark.readStream.format("partition_log").option("partitions", "2").option("startingOffsets", start).load(str(tmp_path)).writeStream.format("parquet")
             .option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r.partition, r.offset, r.value) for r in spark.read.schema(partition_log.SCHEMA).parquet(str(tmp_path / name)).collect())

    assert len(drain("all", "earliest")) == 7 and drain("new", "latest") == []
    with open(tmp_path / "1.log", "a") as f:
        f.write('"}\n{"key":"after"}\n')
    assert drain("new", "latest") == [(1, 4, '{"key":"torn"}'), (1, 5, '{"key":"after"}')]  # latest counts only where there is no checkpoint
    assert len(drain("all", "earliest")) == 9


def test_partition_log_blocks(spark, tmp_path, monkeypatch):
    """Lines longer than a block and blocks that end within a line."""
    monkeypatch.setattr(partition_log, "BLOCK", 7)
    lines = ["", "a", "b" * 30, "é" * 9, "c"]
    (tmp_path / "0.log").write_bytes("".join(x + "\n" for x in lines).encode() + b"torn")
    got = [x.decode() for part in partition_log.whole_lines(str(tmp_path), 0, 0) for x in part]
    assert got == lines
    after = len("".join(x + "\n" for x in lines[:3]).encode())
    assert [x.decode() for part in partition_log.whole_lines(str(tmp_path), 0, after, after + 19) for x in part] == lines[3:4]


def test_paced_generator(spark, tmp_path):
    """The stream draws what the batch draws for the same ids; event times are now, less the skew."""
    src, base = paths(tmp_path, "ckpt", "out")
    before = time.time() * 1000
    q = generator.stream(spark, 200, 30, 5000, 7).writeStream.format("parquet").option("checkpointLocation", src).option("path", base).trigger(processingTime="500 milliseconds").start()
    wait(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 200)
    q.stop()
    got = {r.event_id: r for r in spark.read.schema(EVENT).parquet(base).collect()}
    want = {r.event_id: r for r in generator.generate(spark, 100_000, 30, 5000, 7).collect()}
    assert len(got) >= 200 and all((want[i].key, want[i].event_type, want[i].amount) == (r.key, r.event_type, r.amount) for i, r in got.items())
    assert all(before - 7000 <= r.event_time <= time.time() * 1000 for r in got.values())


def test_kafka_rows(spark):
    """Rows as the connector gives them."""
    schema = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
    rows = [(b"k", v, "t", 1, n, None, 0) for n, v in enumerate((b'{"key":"a","amount":2}', b"\xff", None, b'{"key":7}'))]
    got = topic.from_kafka(spark.createDataFrame(rows, schema)).collect()
    assert [(r.partition, r.offset, r.key, r.amount) for r in got] == [(1, 0, "a", 2.0)] and got[0].ingest_time > 1_700_000_000_000


def test_offsets_of_several_topics(spark, tmp_path):
    os.makedirs(tmp_path / "offsets")
    (tmp_path / "offsets/3").write_text("v1\n" + json.dumps({}) + "\n" + json.dumps({"a": {"0": 5, "1": 6}, "b": {"0": 7}}) + "\n" + json.dumps({"logOffset": 9}))
    (tmp_path / "offsets/4").write_text("v1\n{}\n" + json.dumps({"a": {"0": 8}}))
    assert query.offsets_of(spark, f"file://{tmp_path}", 3) == {"a-0": 5, "a-1": 6, "b-0": 7}
    assert query.offsets_of(spark, f"file://{tmp_path}", 4) == {"0": 8} and query.offsets_of(spark, f"file://{tmp_path}", 5) == {}


def test_empty(spark):
    e = golden(spark).limit(0)
    w = windows.windowed_agg(e, 1000)
    assert w.count() == 0 and windows.split_closed(w, e, True).count() == 0
    assert views.duplicates(w).first().duplicates == 0
