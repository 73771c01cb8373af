"""Record layouts: input events, window rows, commit metadata."""

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("event_time", T.LongType()),
    T.StructField("ingest_time", T.LongType()),
])

WINDOW_ROW = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("window_start", T.LongType()),
    T.StructField("window_end", T.LongType()),
    T.StructField("count", T.LongType()),
    T.StructField("sum_amount", T.DoubleType()),
    T.StructField("min_amount", T.DoubleType()),
    T.StructField("max_amount", T.DoubleType()),
    T.StructField("distinct_types", T.LongType()),
    T.StructField("checkpoint_id", T.LongType()),
])

CHECKPOINT = T.StructType([
    T.StructField("checkpoint_id", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("kafka_offsets", T.MapType(T.StringType(), T.LongType())),
    T.StructField("state_snapshots", T.MapType(T.StringType(), T.StringType())),
    T.StructField("staged_outputs", T.ArrayType(T.StringType())),
])
