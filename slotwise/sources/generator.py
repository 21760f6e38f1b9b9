"""Example events: a fixed number per nominal time, or a steady stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Events per nominal time or second, and the session of streamed events.
EVENTS_PER_RUN = 10
STREAM_SESSION = "1234"


def generate_events(slots: DataFrame, n: int = EVENTS_PER_RUN) -> DataFrame:
    """``n`` events for each row of ``slots``: users 0 to n-1, their number as session, the slot as time."""
    return slots.withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("nominal_time").alias("timestamp"),
        "nominal_time",
    )


def stream_events(spark: SparkSession, n: int = EVENTS_PER_RUN) -> DataFrame:
    """``n`` events per batch without end; run it with a one-second trigger for ``n`` events per second."""
    ticks = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", n)
             .option("numPartitions", 1).load())
    return ticks.select(
        (F.col("value") % n).alias("user_id"),
        F.lit(STREAM_SESSION).alias("session_id"),
        F.localtimestamp().alias("timestamp"),
    )
