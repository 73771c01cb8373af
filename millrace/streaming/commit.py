"""Commit manifests: files count only once a manifest that names them has been renamed into place. All access is by Hadoop's file system API.

A commit has an id, one more than the last, in the order of commits, and the epoch (micro-batch) it is of. Both are in the manifest's name, so an epoch that runs again finds its id without
a file being read. A manifest is replaced by an atomic rename and files are never overwritten: each attempt has a folder of its own. compact() rolls old commits up into one.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CHECKPOINT, WINDOW_ROW

NAME, ROLLED = re.compile(r"^(\d+)-e(-?\d+)\.json$"), re.compile(r"^r(\d+)-(\d+)-[0-9a-f]+\.json$")
_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


def lock(base: str) -> threading.RLock:
    """Of this driver's commits to a base: the sink and the finalizer of a running query take turns."""
    return _locks[base]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of the files and folders in a folder; none if it isn't there."""
    _, p, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _fs(spark, path)
    s = fs.open(p)
    try:
        return bytes(s.readAllBytes()).decode()
    finally:
        s.close()


def put(spark: SparkSession, path: str, text: str) -> None:
    """Written under another name, then renamed over what is there: readers see the old file or the new one, whole."""
    folder, name = path.rsplit("/", 1)
    jvm, tmp, fs = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    final = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, final, how)


def listing(spark: SparkSession, base: str) -> tuple[dict[int, tuple[int, str]], list[str]]:
    """Commits that aren't rolled up, {id: (epoch, path)}, and the paths of the roll-ups that count."""
    found, rolled = {}, []
    for n in names(spark, f"{base}/_commits"):
        if m := NAME.match(n):
            found[int(m[1])] = (int(m[2]), f"{base}/_commits/{n}")
        elif m := ROLLED.match(n):
            rolled.append((int(m[1]), int(m[2]), f"{base}/_commits/{n}"))
    # of nested roll-ups the widest counts
    wide = [r for r in rolled if not any(o is not r and o[0] <= r[0] and r[1] <= o[1] and (o[:2] != r[:2] or o[2] < r[2]) for o in rolled)]
    return {k: v for k, v in sorted(found.items()) if not any(a <= k <= b for a, b, _ in wide)}, [p for _, _, p in sorted(wide)]


def next_id(spark: SparkSession, base: str) -> int:
    ids = [int(m[1]) for n in names(spark, f"{base}/_commits") if (m := NAME.match(n))]
    return max(ids, default=0) + 1


def id_of_epoch(spark: SparkSession, base: str, epoch: int) -> int | None:
    return next((int(m[1]) for n in names(spark, f"{base}/_commits") if (m := NAME.match(n)) and int(m[2]) == epoch), None)


def document(checkpoint_id: int, staged: list[str], offsets: dict[str, int] | None = None, snapshots: dict[str, str] | None = None) -> str:
    # The manifest's keys and its status.
    return json.dumps({"checkpoint_id": checkpoint_id, "created_at": int(time.time() * 1000), "status": "COMPLETED", "kafka_offsets": offsets or {}, "state_snapshots": snapshots or {}, "staged_outputs": staged})


def write_manifest(spark: SparkSession, base: str, checkpoint_id: int, staged: list[str], offsets: dict[str, int] | None = None, snapshots: dict[str, str] | None = None, epoch: int | None = None) -> None:
    """A repeat replaces it."""
    put(spark, f"{base}/_commits/{checkpoint_id}-e{checkpoint_id if epoch is None else epoch}.json", document(checkpoint_id, staged, offsets, snapshots))


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """One row for each completed checkpoint, ascending; none before the first commit."""
    one, rolled = listing(spark, base)
    paths = [p for _, p in one.values()] + rolled
    if not paths:
        return spark.createDataFrame([], CHECKPOINT)
    return spark.read.schema(CHECKPOINT).json(paths).where("status = 'COMPLETED'").orderBy("checkpoint_id")


def ids(spark: SparkSession, base: str) -> DataFrame:
    """checkpoint_id, ascending."""
    return manifests(spark, base).select("checkpoint_id")


def latest(spark: SparkSession, base: str) -> int | None:
    """From the names alone; the last commit's manifest stays even when it is rolled up."""
    return next_id(spark, base) - 1 or None


def committed_offsets(spark: SparkSession, base: str) -> DataFrame:
    """partition, next_offset as of the latest commit."""
    m = manifests(spark, base)
    last = m.agg(F.max_by("kafka_offsets", "checkpoint_id").alias("o"))
    return last.select(F.explode("o").alias("partition", "next_offset")).select(F.col("partition").cast("bigint").alias("partition"), "next_offset")


def committed(spark: SparkSession, base: str, up_to: int | None = None) -> DataFrame:
    """Rows of committed files only, tagged with their checkpoint. Manifests are read on the driver (compact() bounds their number), never rows."""
    m = manifests(spark, base)
    m = m if up_to is None else m.where(F.col("checkpoint_id") <= up_to)
    paths = sorted({p for r in m.select("staged_outputs").toLocalIterator() for p in r[0]})
    if not paths:
        return spark.createDataFrame([], WINDOW_ROW)
    rows = spark.read.schema(WINDOW_ROW).parquet(*(f"{base}/{p}" for p in paths))
    return rows if up_to is None else rows.where(F.col("checkpoint_id") <= up_to)


def compact(spark: SparkSession, base: str, keep: int = 10) -> int:
    """Rolls all commits but the last keep up: their rows into one folder, their manifests into one file. Rows keep their checkpoint, so reads as of any commit still work. Returns how many were rolled up."""
    with lock(base):
        one, _ = listing(spark, base)
        done = manifests(spark, base).collect()[: -keep or None] if one else []
        if sum(r.checkpoint_id in one for r in done) < 2:
            return 0
        lo, hi = done[0].checkpoint_id, done[-1].checkpoint_id
        rel = f"compact={lo}-{hi}/attempt={uuid.uuid4().hex}"
        committed(spark, base, hi).write.parquet(f"{base}/{rel}")
        lines = [json.dumps(r.asDict() | {"staged_outputs": [rel]}) for r in done]
        put(spark, f"{base}/_commits/r{lo}-{hi}-{uuid.uuid4().hex}.json", "\n".join(lines))
        return len(done)


def vacuum(spark: SparkSession, base: str, older_ms: int = 86_400_000) -> int:
    """Removes folders of attempts that no manifest names, manifests that a roll-up covers (but the last), and roll-ups that a wider one covers, if older than older_ms: no reader should have them open any more.
    Returns how many folders."""
    named = {p for r in manifests(spark, base).select("staged_outputs").toLocalIterator() for p in r[0]}
    n, limit = 0, time.time() * 1000 - older_ms
    for top in names(spark, base):
        if "=" not in top:
            continue
        for attempt in names(spark, f"{base}/{top}"):
            _, p, fs = _fs(spark, f"{base}/{top}/{attempt}")
            if attempt.startswith("attempt=") and f"{top}/{attempt}" not in named and fs.getFileStatus(p).getModificationTime() <= limit:
                fs.delete(p, True)
                n += 1
    live, wide = listing(spark, base)
    counts = {p.rsplit("/", 1)[1] for _, p in live.values()} | {p.rsplit("/", 1)[1] for p in wide}
    last = max((int(m[1]) for x in names(spark, f"{base}/_commits") if (m := NAME.match(x))), default=0)
    for x in names(spark, f"{base}/_commits"):
        one = NAME.match(x)
        _, p, fs = _fs(spark, f"{base}/_commits/{x}")
        if x not in counts and (one and int(one[1]) < last or ROLLED.match(x)) and fs.getFileStatus(p).getModificationTime() <= limit:
            fs.delete(p, False)
    return n


def raw(spark: SparkSession, base: str) -> DataFrame:
    """Every Parquet file below the prefix, committed or not."""
    return spark.read.schema(WINDOW_ROW).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(base)
