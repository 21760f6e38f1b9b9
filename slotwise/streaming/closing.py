"""Streams that say which slots are closed, so that schedules can wait for what a stream writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from slotwise.operators.readiness import SLOT, mark_ready, withdraw_marks
from slotwise.schemas import TIME_PARTS
from slotwise.session import delete_path, path_exists
from slotwise.sources.datasets import View, as_view

# How far each source partition has come, and slots that late rows have opened again.
PROGRESS = (StructType().add("source", "string").add("reached", TimestampNTZType())
            .add("opened", TimestampNTZType()).add("closed", TimestampNTZType()))


def closing_sink(write: Callable[[DataFrame, int], None], view: View | str, event_time: str, markers: View | str,
                 progress: str, lateness: str = "0 seconds", source: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of batches that marks the slots of ``view`` as ready once no more rows are expected for them.

    A slot is as long as the finest time part of the view's partitions. It is closed when the stream's time has passed
    its end by ``lateness``; the stream's time is the latest event time of that source partition that has come least far
    (``source`` names the column that tells partitions apart). Slots between the first event and that time are
    marked also if they have no rows. A row that comes for a closed slot withdraws its mark, before it is written; the
    slot is marked again when the stream's time closes another slot. Rows without event time close nothing.

    What has been reached is kept in ``progress`` by query and batch, one small table that each batch derives from the
    one before: a batch that is replayed finds the same state, and marks and withdraws the same slots. A partition that
    falls silent holds the time back; one that is new is counted from its first row on.
    """
    view = as_view(view)
    unit = [part for part in TIME_PARTS if part in view.parts][-1:]
    if not unit:
        raise ValueError(f"{view.uri}: no partition column tells the slots of a stream apart")

    def slot_of_time(at: Column) -> Column:
        return F.date_trunc(unit[0], at).cast("timestamp_ntz")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        here = f"{progress}/{query}"
        batch = batch.persist()
        try:
            before = _progress(spark, here, batch_id - 1)
            closed = before.agg(F.max("closed")).first()[0]
            times = batch.where(F.col(event_time).isNotNull()).select(
                (F.col(source).cast("string") if source else F.lit("")).alias("source"), F.col(event_time).alias("at"))
            late = times.select(slot_of_time(F.col("at")).alias(SLOT)).distinct()
            late = late.where(F.col(SLOT) < F.lit(closed)) if closed is not None else late.limit(0)
            name = view.known(spark).marks
            if closed is not None:
                withdraw_marks(late, [name], markers)
            write(batch, batch_id)
            # Sources merge with what they had reached; a task sends one row for each.
            came = times.groupBy("source").agg(F.max("at").alias("reached"))
            reached = before.where("reached is not null").select("source", "reached").unionByName(came).groupBy("source").agg(
                F.max("reached").alias("reached"))
            now = reached.agg(slot_of_time(F.min("reached") - F.expr(f"interval {lateness}")).alias("closed"))
            start = F.lit(closed) if closed is not None else F.lit(times.agg(slot_of_time(F.min("at"))).first()[0])
            end = now.first()[0]
            advanced = end is not None and (closed is None or end > closed)
            opened = late.select(F.col(SLOT).alias("opened"))
            held = before.where("opened is not null").select("opened")
            if advanced:
                step = F.expr(f"interval 1 {unit[0]}")
                new = spark.range(1).select(F.explode(F.sequence(
                    start, F.greatest(start, F.lit(end)), step)).alias(SLOT)).where(F.col(SLOT) < F.lit(end))
                again = held.join(opened, "opened", "left_anti").select(F.col("opened").alias(SLOT))
                mark_ready(new.unionByName(again), name, markers)
            else:
                opened = opened.unionByName(held).distinct()
            until = F.lit(end if advanced else closed).cast("timestamp_ntz")
            state = reached.withColumn("opened", F.lit(None).cast("timestamp_ntz")).unionByName(
                opened.select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("reached"), "opened"))
            state.withColumn("closed", until).coalesce(1).write.mode("overwrite").parquet(f"{here}/{batch_id}")
            delete_path(spark, f"{here}/{batch_id - 2}")
        finally:
            batch.unpersist()

    return write_batch


def _progress(spark: SparkSession, here: str, batch_id: int) -> DataFrame:
    path = f"{here}/{batch_id}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(path)
