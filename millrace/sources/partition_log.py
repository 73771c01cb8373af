"""A partitioned log read by offsets, as a Python data source. A position is, for each partition, the next offset and the byte it begins at; it goes to Spark's offset log, so nothing is read twice."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset bigint, value string"
BLOCK = 1 << 22


class Slice(InputPartition):
    def __init__(self, partition: int, offset: int, start: int, end: int | None):
        self.partition, self.offset, self.start, self.end = partition, offset, start, end


def local(path: str) -> str:
    return path.removeprefix("file://")


def whole_lines(root: str, partition: int, start: int, end: int | None = None) -> Iterator[list[bytes]]:
    """Whole lines from a byte on, in blocks. A partition is the file <root>/<partition>.log, on storage that all executors mount; one that isn't there is empty, and a torn last line isn't there yet."""
    path = f"{local(root)}/{partition}.log"
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        f.seek(start)
        left, rest = (None if end is None else end - start), b""
        while block := f.read(BLOCK if left is None else min(BLOCK, left)):
            left = None if left is None else left - len(block)
            *lines, rest = (rest + block).split(b"\n")
            if lines:
                yield lines


def rows(root: str, s: Slice) -> Iterator[pa.RecordBatch]:
    at = s.offset
    for lines in whole_lines(root, s.partition, s.start, s.end):
        n = len(lines)
        values = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([s.partition] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), values], names=["partition", "offset", "value"])
        at += n


class LogStream(DataSourceStreamReader):
    def __init__(self, o: dict):
        self.root, self.n = o["path"], int(o.get("partitions", "6"))
        self.latest = o.get("startingoffsets", "earliest") == "latest"
        self.known = {str(p): {"offset": 0, "byte": 0} for p in range(self.n)}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.latest else {str(p): {"offset": 0, "byte": 0} for p in range(self.n)}

    def latestOffset(self) -> dict:
        """Only what has come since the last look is read."""
        out = {}
        for p, k in self.known.items():
            offset, byte = k["offset"], k["byte"]
            for lines in whole_lines(self.root, int(p), byte):
                offset, byte = offset + len(lines), byte + sum(map(len, lines)) + len(lines)
            out[p] = {"offset": offset, "byte": byte}
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        none = {"offset": 0, "byte": 0}
        return [Slice(int(p), start.get(p, none)["offset"], start.get(p, none)["byte"], e["byte"]) for p, e in end.items() if e["byte"] > start.get(p, none)["byte"]]

    def read(self, s: Slice) -> Iterator[pa.RecordBatch]:
        return rows(self.root, s)

    def commit(self, end: dict) -> None:
        pass


class LogBatch(DataSourceReader):
    def __init__(self, o: dict):
        self.root, self.n = o["path"], int(o.get("partitions", "6"))

    def partitions(self) -> list[Slice]:
        return [Slice(p, 0, 0, None) for p in range(self.n)]

    def read(self, s: Slice) -> Iterator[pa.RecordBatch]:
        return rows(self.root, s)


class PartitionLog(DataSource):
    """Options: path, partitions (6), startingOffsets (earliest or latest, where there is no checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return "partition_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogBatch:
        return LogBatch(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartitionLog)


def write(records: DataFrame, path: str) -> int:
    """Writes records (partition, offset, value) as a log; returns their number. A task streams its partitions, and a file appears whole, so a task may run again."""
    root = local(path)
    os.makedirs(root, exist_ok=True)

    def run(batches):
        import uuid

        now, f, tmp, n = None, None, None, 0

        def close():
            f.close()
            os.replace(tmp, f"{root}/{now}.log")

        for b in batches:
            for p, v in zip(b.column("partition").to_pylist(), b.column("value").to_pylist(), strict=True):
                if p != now:
                    if f is not None:
                        close()
                    now, tmp = p, f"{root}/.{p}.{uuid.uuid4().hex}"
                    f = open(tmp, "wb")  # noqa: SIM115
                f.write(v.encode() + b"\n")
                n += 1
        if f is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = records.select("partition", "offset", "value").repartition(F.col("partition")).sortWithinPartitions("partition", "offset")
    return dealt.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
