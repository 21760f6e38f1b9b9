"""Record schemas shared by sources, jobs and tests."""

from __future__ import annotations

from pyspark.sql import types as T

# Time columns of a slot, outermost folder first.
TIME_PARTS = ("year", "month", "day", "hour", "minute")

# Field names and types of the example records.
EVENT = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])

REPORT = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("event_count", T.LongType(), False),
])

KEY_VALUES = T.StructType([
    T.StructField("jobsettings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("inputsettings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("outputsettings", T.MapType(T.StringType(), T.StringType())),
])

# One row per signalled slot of a view.
MARKER = T.StructType([
    T.StructField("view", T.StringType(), False),
    T.StructField("nominal_time", T.TimestampNTZType(), False),
    T.StructField("signalled_at", T.TimestampNTZType(), False),
    T.StructField("run_id", T.StringType(), False),
])

# What a topic holds when it is kept in files; a broker's source adds its own columns.
TOPIC = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Partition columns of what streams write: the query that wrote a row, and in which of its batches.
BATCH_PARTS = ("query_id", "batch_id")


def with_batch_parts(schema: T.StructType) -> T.StructType:
    """Schema of a catalog table that streams write records of ``schema`` to, partitioned by ``BATCH_PARTS``."""
    return T.StructType([
        *schema.fields,
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ])
