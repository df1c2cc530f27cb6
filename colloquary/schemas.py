"""The two row shapes every operator works on."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("space_id", T.StringType()),
    T.StructField("conv_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
])

CAPTURES = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("capture_id", T.LongType()),
    T.StructField("captured_at", T.TimestampNTZType()),
    T.StructField("state", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
