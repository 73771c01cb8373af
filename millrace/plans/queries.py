"""The named queries and, for each, DuckDB SQL with the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse, routing, windows
from ..operators import metrics, views
from ..sources import generator, partition_log, tables
from ..streaming import commit, lakehouse, query

DAY = 86_400_000
JITTER = 10_800_000
N_BUCKETS, N_PARTITIONS, N_WORKERS = 64, 6, 3
FOLD_MS = 20_000
#: State partitions of the streaming queries here, whose tables are small; a query's own number follows from its state.
STATE_PARTITIONS = 4

EV = """ev as (select cast(event_id as varchar) as event_id, 'user_' || user_id as key, event_type, value as amount,
  epoch_us(ts) // 1000 as event_time, event_id as eid from events)"""
WIN = f"""win as (select key, event_time - event_time % {DAY} as window_start, event_time - event_time % {DAY} + {DAY} as window_end,
  count(*) as "count", sum(amount) as s, min(amount) as min_amount, max(amount) as max_amount, count(distinct event_type) as distinct_types
  from ev group by 1, 2, 3)"""
ROW = 'key, window_start, window_end, "count", cast(round(s * 100) as bigint) as sum_cents, min_amount, max_amount, distinct_types'
CK = f"ck as (select *, 1 + (window_end - (select min(window_end) from win)) // {DAY} as checkpoint_id from win)"


def ev(spark: SparkSession, d: str) -> DataFrame:
    return tables.events(spark, d)


def win(spark: SparkSession, d: str) -> DataFrame:
    return windows.windowed_agg(ev(spark, d), DAY)


def shown(rows: DataFrame) -> DataFrame:
    """Sums in cents, so that the order of addition doesn't show."""
    return rows.select("key", "window_start", "window_end", "count", views.cents(F.col("sum_amount")).alias("sum_cents"), "min_amount", "max_amount", "distinct_types")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a checkpoint id that follows from their end. The first window's end follows from the least event time, so nothing is aggregated twice."""
    start = windows.window_start(F.min("event_time"), DAY)
    first = F.broadcast(ev(spark, d).agg((start + DAY).alias("_first")))  # one row
    return win(spark, d).crossJoin(first).withColumn("checkpoint_id", F.expr(f"1 + (window_end - _first) div {DAY}")).drop("_first")


def replayed(spark: SparkSession, d: str) -> DataFrame:
    """Each window once, and every window of an odd checkpoint again under the next one, with one more event. One pass: a window is exploded, not read again."""
    once, again = F.struct("checkpoint_id", "count"), F.struct((F.col("checkpoint_id") + 1).alias("checkpoint_id"), (F.col("count") + 1).alias("count"))
    both = F.when(F.col("checkpoint_id") % 2 == 1, F.array(once, again)).otherwise(F.array(once))
    t = tagged(spark, d).withColumn("_c", F.explode(both))
    return t.withColumn("checkpoint_id", F.col("_c.checkpoint_id")).withColumn("count", F.col("_c.count")).drop("_c")


REPLAY = f"""with {EV}, {WIN}, {CK}, rep as (select key, window_start, checkpoint_id, "count", s, min_amount, max_amount from ck
  union all select key, window_start, checkpoint_id + 1, "count" + 1, s, min_amount, max_amount from ck where checkpoint_id % 2 = 1)"""


def base_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir); there it is the caller's to remove. Where none is set and all is one process, a folder of our own, removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}/base"


def stream_source(own: SparkSession, d: str) -> DataFrame:
    raw = tables.read(own, d, "events")
    return tables.as_events(own.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet"))


def stream_run(spark: SparkSession, d: str, final: bool, mode: str = "staged") -> str:
    """The events table through the streaming query; returns the base of what it published. Its files stay: the result reads them."""
    tables.pin_utc(spark)
    own, base, ckpt = query.session(spark, STATE_PARTITIONS), base_dir(spark), base_dir(spark)
    query.start(stream_source(own, d), base, ckpt, DAY, mode=mode).awaitTermination()
    if final:
        query.finalize(own, base, ckpt, DAY)
    return base


def streamed(spark: SparkSession, d: str, final: bool) -> DataFrame:
    return shown(views.first_wins(commit.committed(spark, stream_run(spark, d, final)), ["checkpoint_id"]))


def stream_direct(spark: SparkSession, d: str) -> DataFrame:
    """At-least-once mode: rows count as soon as they are there."""
    return shown(views.first_wins(commit.raw(spark, stream_run(spark, d, False, "direct")), ["count"]))


def stream_report(spark: SparkSession, d: str) -> DataFrame:
    return views.verify_report(commit.committed(spark, stream_run(spark, d, True)))


def lake(spark: SparkSession, d: str) -> str:
    """A versioned table with the commits of a streaming run: closed windows, then open ones."""
    base, table = stream_run(spark, d, True), base_dir(spark)
    lakehouse.append(spark, base, table)
    return table


def log_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets in the latest commit of a query that reads a partitioned log of the events."""
    tables.pin_utc(spark)
    own, log, base, ckpt = query.session(spark, STATE_PARTITIONS), base_dir(spark), base_dir(spark), base_dir(spark)
    e = ev(spark, d).select(F.pmod(F.col("event_id").cast("bigint"), F.lit(N_PARTITIONS)).cast("int").alias("partition"), F.col("event_id").cast("bigint").alias("offset"),
                            F.to_json(F.struct("event_id", "key", "event_type", "amount", "event_time")).alias("value"))
    partition_log.write(e, log)
    partition_log.register(own)
    src = own.readStream.format("partition_log").option("partitions", N_PARTITIONS).load(log)
    query.run_bounded(parse.decode(src, keep=("partition", "offset")), base, ckpt, DAY)
    return commit.committed_offsets(spark, base)


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """What is committed after old commits were rolled up."""
    base = stream_run(spark, d, True)
    commit.compact(spark, base, keep=0)
    return shown(views.first_wins(commit.committed(spark, base), ["checkpoint_id"]))


def open_state(spark: SparkSession, d: str) -> DataFrame:
    """What the streaming query holds in state at its end: the open windows by key and type."""
    tables.pin_utc(spark)
    own, base, ckpt = query.session(spark, STATE_PARTITIONS), base_dir(spark), base_dir(spark)
    query.start(stream_source(own, d), base, ckpt, DAY).awaitTermination()
    s = query.state(own, ckpt)
    return s.select("key", "window_start", "event_type", F.col("n").alias("count"), views.cents(F.col("s")).alias("sum_cents"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters over the micro-batches of a run."""
    tables.pin_utc(spark)
    own, base, ckpt = query.session(spark, STATE_PARTITIONS), base_dir(spark), base_dir(spark)
    q = query.start(stream_source(own, d), base, ckpt, DAY)
    q.awaitTermination()
    return metrics.scrape(spark, [query.progress(p) for p in q.recentProgress]).select("events_consumed", "events_late")


def generated(spark: SparkSession, d: str) -> DataFrame:
    """What a seeded run of the generator must be like."""
    e = generator.generate(spark, 20_000, 50, 3000, 7)
    skew = F.lit(1_700_000_000_000) - F.col("event_time")  # at most, as later events happen later
    return e.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"), F.countDistinct("key").alias("keys"), F.countDistinct("event_type").alias("types"),
                 F.sum((~F.col("amount").between(0, 99.99) | (skew > 3000)).cast("bigint")).alias("outside"))


def shown_back(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sum_amount", F.col("sum_cents") / 100)


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    keys = ev(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    return keys.withColumn("bucket", routing.bucket(F.col("key"), N_BUCKETS))


FNV = f"""list_reduce(list_prepend({routing.OFFSET}::bigint, list_transform(range(1, length(key) + 1),
  lambda i: ascii(substr(key, i::int, 1))::bigint)), lambda h, b: (xor(h, b) * {routing.PRIME}) & {routing.MASK}) % {N_BUCKETS}"""
KEYS = f"with {EV}, k as (select key, count(*) as n_events from ev group by 1), b as (select key, n_events, cast({FNV} as integer) as bucket from k)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Partition and offset of each event, as a log that deals them by id modulo 6 has them."""
    e = tables.read(spark, d, "events").select("event_id")
    return e.select(F.pmod("event_id", F.lit(N_PARTITIONS)).alias("partition"), F.expr(f"event_id div {N_PARTITIONS}").alias("offset"))


def other(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counts per key, and those of a run that lost every third key and one purchase of each other key."""
    base = views.key_rollup(win(spark, d))
    n = F.substring_index("key", "_", -1).cast("bigint")
    run = base.where(n % 3 != 0).withColumn("count", F.col("count") - (n % 2))
    return base, run


ROLL = f"""with {EV}, {WIN}, base as (select key, sum("count")::bigint as c from win group by 1),
  run as (select key, c - cast(split_part(key, '_', 2) as bigint) % 2 as c from base where cast(split_part(key, '_', 2) as bigint) % 3 <> 0)"""


def latencies(spark: SparkSession, d: str) -> DataFrame:
    """Events folded up to 20 s after their own time: latency in milliseconds."""
    e = ev(spark, d)
    return e.select("event_id", metrics.latency_ms(F.col("event_time"), F.col("event_time") + F.col("event_id").cast("bigint") * 7919 % FOLD_MS).alias("ms"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints with a made-up duration of up to 30 s."""
    return tagged(spark, d).select("checkpoint_id").distinct().select("checkpoint_id", (F.col("checkpoint_id") * 977 % 30_000).cast("double").alias("ms"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Regions as workers, in an order of joining that isn't that of their names."""
    return tables.read(spark, d, "region").select(F.col("r_name").alias("worker"), (F.col("r_regionkey").cast("bigint") * 3 % 5).alias("join_seq"))


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Records, four of six as they shouldn't be: names in capitals, a key that is a number, a torn one, one without an amount, a time with a point."""
    e = ev(spark, d)
    k = F.pmod(F.col("event_id").cast("bigint"), F.lit(6))
    part = lambda key, amount, time: F.format_string('{"event_id":"%s","' + key + '%s"' + amount + ',"event_time":%s' + time + "}", "event_id", "key", F.col("event_time").cast("string"))
    number = F.format_string('{"event_id":"%s","key":%s}', "event_id", "event_id")
    text = (F.when(k == 0, part('key":"', ',"amount":2.5', "")).when(k == 1, part('KEY":"', ',"Amount":3', "")).when(k == 2, number)
            .when(k == 3, F.expr("substring(to_json(struct(event_id, key)), 1, 12)")).when(k == 4, part('key":"', "", "")).otherwise(part('key":"', "", ".0")))
    return e.select(text.alias("value"))




def hist_sql(values: str, bounds: tuple[int, int]) -> str:
    """The histogram of a relation's column ms."""
    top = ", ".join(str(bounds[0] * 2**i) for i in range(bounds[1]))
    return f"""{values}, lat as (select coalesce((select min(b) from (select unnest([{top}]) as b) where b >= ms)::double, 'infinity'::double) as le from vals),
  h as (select le, count(*) as n from lat group by 1), c as (select le, n, cast(sum(n) over (order by le) as bigint) as cumulative from h)"""


def quantile_sql(hist: str, bounds: tuple[int, int]) -> str:
    low = f"(case when le <= {bounds[0]} then 0 else le / 2 end)"
    return f"""{hist}, d as (select le, cumulative, coalesce(lag(cumulative) over (order by le), 0) as below, (select sum(n) from h) as total from c),
  q as (select unnest([{", ".join(f"cast({x} as double)" for x in metrics.QUANTILES)}]) as q)
  select q, case when isinf(le) then cast({bounds[0] * 2 ** (bounds[1] - 1)} as double) else {low} + (le - {low}) * (q * total - below) / (cumulative - below) end as value
  from d, q where cumulative >= q * total and below < q * total"""



QUERIES = {
    "tumbling_window_agg": lambda s, d: shown(win(s, d)),
    "stream_tumbling_window_agg": lambda s, d: streamed(s, d, True),
    "stream_emitted_only": lambda s, d: streamed(s, d, False),
    "closed_windows": lambda s, d: shown(windows.split_closed(win(s, d), ev(s, d), True)),
    "open_windows": lambda s, d: shown(windows.split_closed(win(s, d), ev(s, d), False)),
    "key_bucket": lambda s, d: bucketed(s, d).select("key", "bucket"),
    "bucket_load": lambda s, d: bucketed(s, d).groupBy("bucket").agg(F.sum("n_events").alias("n_events")),
    "bucket_owner": lambda s, d: routing.owners(s, N_BUCKETS, N_WORKERS, "bucket"),
    "partition_owner": lambda s, d: routing.owners(s, N_PARTITIONS, N_WORKERS, "partition"),
    "member_order": lambda s, d: routing.member_order(members(s, d)),
    "member_bucket_owner": lambda s, d: routing.owners(s, N_BUCKETS, members(s, d), "bucket"),
    "restore_owned_buckets": lambda s, d: shown(routing.restore_owned(win(s, d), [0, 2], 4)),
    "partition_offsets": lambda s, d: views.offsets(records(s, d)),
    "offsets_total": lambda s, d: views.offsets(records(s, d)).agg(F.sum("next_offset").alias("total")),
    "key_rollup": lambda s, d: views.key_rollup(win(s, d)),
    "verify_report": lambda s, d: views.verify_report(replayed(s, d)),
    "committed_dedup": lambda s, d: views.first_wins(replayed(s, d), ["checkpoint_id"]).select("key", "window_start", "checkpoint_id", "count"),
    "per_checkpoint_dedup": lambda s, d: views.first_wins(replayed(s, d), ["count"], ("checkpoint_id", "key", "window_start")).select("key", "window_start", "checkpoint_id", "count"),
    "duplicate_windows": lambda s, d: views.duplicates(replayed(s, d)),
    "reconcile_missing": lambda s, d: views.missing(*other(s, d)).select("key", "count"),
    "reconcile_lost": lambda s, d: views.lost(*other(s, d)),
    "snapshot_history": lambda s, d: views.history(tagged(s, d)),
    "time_travel_count": lambda s, d: views.time_travel(tagged(s, d)),
    "watermark_progress": lambda s, d: windows.watermark_progress(ev(s, d), DAY),
    "late_events": lambda s, d: windows.late_events(ev(s, d), F.col("event_time") + F.col("event_id").cast("bigint") * (7919 * 1009) % JITTER, DAY, JITTER),
    "event_latency": lambda s, d: latencies(s, d),
    "latency_histogram": lambda s, d: metrics.histogram(latencies(s, d), "ms"),
    "latency_quantiles": lambda s, d: metrics.quantiles(metrics.histogram(latencies(s, d), "ms")),
    "checkpoint_duration_histogram": lambda s, d: metrics.histogram(durations(s, d), "ms", metrics.CHECKPOINT_DURATION),
    "checkpoint_duration_quantiles": lambda s, d: metrics.quantiles(metrics.histogram(durations(s, d), "ms", metrics.CHECKPOINT_DURATION), bounds=metrics.CHECKPOINT_DURATION),
    "max_gauge": lambda s, d: durations(s, d).agg(F.max("checkpoint_id").alias("last_completed")),
    "throughput_rate": lambda s, d: metrics.rate(ev(s, d), 3_600_000),
    "json_roundtrip": lambda s, d: parse.decode(parse.encode(ev(s, d).withColumn("ingest_time", F.lit(0).cast("bigint")))),
    "prop_extract": lambda s, d: tables.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
    "malformed_skip": lambda s, d: parse.decode(dirty(s, d)).select("event_id", "key", "amount", "event_time"),
    "ingest_stamp": lambda s, d: parse.decode(parse.encode(ev(s, d).withColumn("ingest_time", F.lit(0).cast("bigint"))), stamp=True).select("event_id", (F.col("ingest_time") > F.col("event_time")).alias("stamped")),
    "processing_time_window": lambda s, d: shown(windows.windowed_agg(ev(s, d).withColumn("ingest_time", F.col("event_time") + F.col("event_id").cast("bigint") * 7919 % FOLD_MS), DAY, "ingest_time")),
    "composite_id": lambda s, d: win(s, d).select(F.concat_ws("@", "key", "window_start").alias("id")),
    "total_events": lambda s, d: win(s, d).agg(F.sum("count").alias("events"), F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("rows")),
    "rollup_lines": lambda s, d: views.rollup_lines(views.key_rollup(win(s, d))),
    "rollup_diff": lambda s, d: views.rollup_diff(*(x.select("key", "count") for x in other(s, d))),
    "rollup_diff_none": lambda s, d: views.rollup_diff(views.key_rollup(win(s, d)), views.key_rollup(shown_back(streamed(s, d, True)))),
    "stream_direct": lambda s, d: stream_direct(s, d),
    "stream_verify_report": lambda s, d: stream_report(s, d),
    "stream_compacted": lambda s, d: compacted(s, d),
    "committed_offsets": lambda s, d: log_offsets(s, d),
    "committed_offsets_total": lambda s, d: log_offsets(s, d).agg(F.sum("next_offset").alias("total")),
    "all_checkpoints": lambda s, d: commit.manifests(s, stream_run(s, d, True)).select("checkpoint_id", "status"),
    "latest_checkpoint": lambda s, d: s.createDataFrame([(commit.latest(s, stream_run(s, d, True)),)], "latest bigint"),
    "lakehouse_snapshots": lambda s, d: lakehouse.snapshots(s, lake(s, d)),
    "lakehouse_as_of_first": lambda s, d: shown(lakehouse.as_of(s, lake(s, d), 1)),
    "lakehouse_current": lambda s, d: s.createDataFrame([(lakehouse.current(s, lake(s, d)),)], "current bigint"),
    "open_state": lambda s, d: open_state(s, d),
    "stream_counters": lambda s, d: counters(s, d),
    "generator_shape": lambda s, d: generated(s, d),
    "lakehouse_report": lambda s, d: lakehouse.report(s, lake(s, d)),
}

AT = f"event_time + (eid * {7919 * 1009}) % {JITTER}"
CLOSED = "(select max(event_time) - 1000 from ev)"
LAT = f"vals as (select event_id, (eid * 7919 % {FOLD_MS})::double as ms from ev)"
LAT_HIST = hist_sql(f"with {EV}, {LAT}", metrics.EVENT_LATENCY)
DUR_HIST = hist_sql(f"with {EV}, {WIN}, {CK}, vals as (select distinct checkpoint_id, (checkpoint_id * 977 % 30000)::double as ms from ck)", metrics.CHECKPOINT_DURATION)
MEMBERS = "m as (select r_name as worker, cast(row_number() over (order by r_regionkey * 3 % 5, r_name) - 1 as integer) as place from region)"
ORACLES = {
    "tumbling_window_agg": f"with {EV}, {WIN} select {ROW} from win",
    "stream_tumbling_window_agg": f"with {EV}, {WIN} select {ROW} from win",
    "stream_emitted_only": f"with {EV}, {WIN} select {ROW} from win where window_end <= {CLOSED}",
    "closed_windows": f"with {EV}, {WIN} select {ROW} from win where window_end <= {CLOSED}",
    "open_windows": f"with {EV}, {WIN} select {ROW} from win where window_end > {CLOSED}",
    "key_bucket": f"{KEYS} select key, bucket from b",
    "bucket_load": f"{KEYS} select bucket, cast(sum(n_events) as bigint) as n_events from b group by 1",
    "bucket_owner": f"select range as bucket, range % {N_WORKERS} as owner from range({N_BUCKETS})",
    "partition_owner": f'select range as "partition", range % {N_WORKERS} as owner from range({N_PARTITIONS})',
    "restore_owned_buckets": f"with {EV}, {WIN}, w as (select *, {FNV.rsplit('%', 1)[0]} % 4 as b from win) select {ROW} from w where b in (0, 2)",
    "partition_offsets": f'select event_id % {N_PARTITIONS} as "partition", max(event_id // {N_PARTITIONS}) + 1 as next_offset from events group by 1',
    "offsets_total": f"select cast(sum(n) as bigint) as total from (select max(event_id // {N_PARTITIONS}) + 1 as n from events group by event_id % {N_PARTITIONS})",
    "key_rollup": f'with {EV}, {WIN} select key, cast(sum("count") as bigint) as "count", cast(round(sum(s) * 100) as bigint) as sum_cents, min(min_amount) as min_amount, max(max_amount) as max_amount from win group by 1',
    "verify_report": f"""{REPLAY}, f as (select * from rep qualify row_number() over (partition by key, window_start order by checkpoint_id) = 1)
      select cast(sum("count") as bigint) as events, count(distinct key) as keys, count(*) as "rows", (select count(*) from rep) - count(*) as duplicates from f""",
    "committed_dedup": f'{REPLAY} select key, window_start, checkpoint_id, "count" from rep qualify row_number() over (partition by key, window_start order by checkpoint_id) = 1',
    "per_checkpoint_dedup": f'{REPLAY} select key, window_start, checkpoint_id, "count" from rep qualify row_number() over (partition by checkpoint_id, key, window_start order by "count") = 1',
    "duplicate_windows": f"{REPLAY}, g as (select key, window_start, count(*) as n from rep group by 1, 2) select cast(sum(n - 1) as bigint) as duplicates, count(*) as windows from g",
    "reconcile_missing": f'{ROLL} select key, c as "count" from base where not exists (select 1 from run where run.key = base.key)',
    "reconcile_lost": f"{ROLL} select base.key, base.c as base_count, coalesce(run.c, 0) as other_count from base left join run on run.key = base.key where coalesce(run.c, 0) < base.c",
    "snapshot_history": f"with {EV}, {WIN}, {CK}, g as (select checkpoint_id, count(*) as added_rows from ck group by 1) select cast(row_number() over (order by checkpoint_id) as integer) as sequence, checkpoint_id, added_rows, cast(sum(added_rows) over (order by checkpoint_id) as bigint) as total_rows from g",
    "time_travel_count": f"with {EV}, {WIN}, {CK} select count(*) filter (where checkpoint_id = (select min(checkpoint_id) from ck)) as first_rows, count(*) as last_rows, count(*) - count(*) filter (where checkpoint_id = (select min(checkpoint_id) from ck)) as difference from ck",
    "watermark_progress": f"with {EV}, g as (select event_time - event_time % {DAY} as step_start, max(event_time) as top, count(*) as n_events from ev group by 1) select step_start, n_events, max(top) over (order by step_start) - 1000 as watermark from g",
    "late_events": f"""with {EV}, r as (select *, max(event_time) over (order by {AT}, eid rows between unbounded preceding and 1 preceding) as top from ev)
      select event_id, key, event_time, top - 1000 as watermark from r where event_time - event_time % {DAY} + {DAY} <= top - 1000""",
    "event_latency": f"with {EV}, {LAT} select event_id, ms from vals",
    "latency_histogram": f"{LAT_HIST} select le, n, cumulative from c",
    "latency_quantiles": quantile_sql(LAT_HIST, metrics.EVENT_LATENCY),
    "checkpoint_duration_histogram": f"{DUR_HIST} select le, n, cumulative from c",
    "checkpoint_duration_quantiles": quantile_sql(DUR_HIST, metrics.CHECKPOINT_DURATION),
    "max_gauge": f"with {EV}, {WIN}, {CK} select max(checkpoint_id) as last_completed from ck",
    "member_order": f"with {MEMBERS} select worker, place from m",
    "member_bucket_owner": f"with {MEMBERS} select range as bucket, worker as owner from range({N_BUCKETS}), m where range % (select count(*) from m) = place",
    "malformed_skip": f"""with {EV} select event_id, key, case eid % 6 when 0 then 2.5 when 1 then 3.0 else 0.0 end::double as amount, event_time from ev where eid % 6 in (0, 1, 4)""",
    "ingest_stamp": "select cast(event_id as varchar) as event_id, true as stamped from events",
    "processing_time_window": f"with {EV.replace('epoch_us(ts) // 1000 as event_time', f'epoch_us(ts) // 1000 + event_id * 7919 % {FOLD_MS} as event_time')}, {WIN} select {ROW} from win",
    "composite_id": f"with {EV}, {WIN} select key || '@' || window_start as id from win",
    "total_events": f'with {EV}, {WIN} select cast(sum("count") as bigint) as events, count(distinct key) as keys, count(*) as "rows" from win',
    "rollup_lines": f"""with {EV}, {WIN} select key || chr(9) || cast(sum("count") as bigint) || chr(9) || cast(round(sum(s) * 100) as bigint) || chr(9) || printf('%.2f', min(min_amount)) || chr(9) || printf('%.2f', max(max_amount)) as line from win group by key""",
    "rollup_diff": f"""{ROLL} select key, c as "count", 'a' as side from (select * from base except all select * from run) union all select key, c, 'b' from (select * from run except all select * from base)""",
    "rollup_diff_none": "select '' as key, 0::bigint as \"count\", 0::bigint as sum_cents, 0.0::double as min_amount, 0.0::double as max_amount, '' as side where false",
    "stream_direct": f"with {EV}, {WIN} select {ROW} from win where window_end <= {CLOSED}",
    "stream_verify_report": f'with {EV}, {WIN} select cast(sum("count") as bigint) as events, count(distinct key) as keys, count(*) as "rows", 0::bigint as duplicates from win',
    "stream_compacted": f"with {EV}, {WIN} select {ROW} from win",
    "committed_offsets": f'select event_id % {N_PARTITIONS} as "partition", count(*) as next_offset from events group by 1',
    "committed_offsets_total": "select count(*) as total from events",
    "all_checkpoints": "select unnest([1, 2])::bigint as checkpoint_id, 'COMPLETED' as status",
    "lakehouse_snapshots": f"""with {EV}, {WIN}, g as (select case when window_end <= {CLOSED} then 1 else 2 end as checkpoint_id, count(*) as added_rows from win group by 1)
      select cast(row_number() over (order by checkpoint_id) as integer) as sequence, checkpoint_id::bigint as checkpoint_id, added_rows, cast(sum(added_rows) over (order by checkpoint_id) as bigint) as total_rows from g""",
    "lakehouse_as_of_first": f"with {EV}, {WIN} select {ROW} from win where window_end <= {CLOSED}",
    "lakehouse_current": "select 2::bigint as current",
    "open_state": f"with {EV} select key, event_time - event_time % {DAY} as window_start, event_type, count(*) as \"count\", cast(round(sum(amount) * 100) as bigint) as sum_cents from ev where event_time - event_time % {DAY} + {DAY} > {CLOSED} group by 1, 2, 3",
    "stream_counters": "select count(*) as events_consumed, 0::bigint as events_late from events",
    "generator_shape": "select 20000::bigint as events, 20000::bigint as ids, 50::bigint as keys, 5::bigint as types, 0::bigint as outside",
    "lakehouse_report": f"with {EV}, {WIN} select count(*) filter (where window_end <= {CLOSED}) as first_rows, count(*) as last_rows, count(*) filter (where window_end > {CLOSED}) as difference from win",
    "throughput_rate": f"with {EV} select event_time - event_time % 3600000 as window_start, count(*) as n_events, count(*) / cast(3600.0 as double) as per_second from ev group by 1",
    "json_roundtrip": f"with {EV} select event_id, key, event_type, amount, event_time, cast(0 as bigint) as ingest_time from ev",
    "prop_extract": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "latest_checkpoint": "select 2::bigint as latest",
}
