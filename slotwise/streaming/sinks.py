"""Stateless streams into datasets and topics, safe against restarts and replayed batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions.timeparts import time_parts
from slotwise.operators.sinks import cluster_by_slot, overwrite_slots
from slotwise.schemas import BATCH_PARTS, TIME_PARTS
from slotwise.sources.datasets import View, as_view
from slotwise.sources.topics import Topic, send_to_folder, to_messages
from slotwise.streaming.closing import closing_sink

# Fixed value: one batch per second.
BATCH_INTERVAL = "1 second"


def for_each_batch(sdf: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str,
                   available_now: bool = False, interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Run ``write_batch`` for each micro-batch; ``available_now`` stops after what has arrived so far."""
    return (sdf.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(available_now, interval)).start())


def _trigger(available_now: bool, interval: str) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": interval}


def stream_to_dataset(sdf: DataFrame, view: View | str, checkpoint: str, available_now: bool = False,
                      interval: str = BATCH_INTERVAL, event_time: str | None = None, markers: View | str | None = None,
                      lateness: str = "0 seconds", source: str | None = None) -> StreamingQuery:
    """Write each batch that has rows into a dataset, under the dataset's partitions and in a folder of its own there.

    Partition columns are taken from the view's constraints, from the record, or from the parts of ``event_time``;
    a layout that cannot be met so is refused. Below them come ``BATCH_PARTS``: a batch that is replayed after a lost
    commit replaces its own folders, where an append would double its rows. Rows of a batch for the same slots come
    from the same messages, so a replay has the same folders. Readers of a view do not see the batch columns. A
    catalog table has to be partitioned by its parts and then ``BATCH_PARTS`` (see :func:`with_batch_parts`). With ``markers`` the slots
    of a stream with event times are marked ready as they close, see :func:`closing_sink`.
    """
    write = dataset_sink(sdf if source is None else sdf.drop(source), view, event_time)
    if markers is not None and event_time is not None:
        plain = write if source is None else lambda batch, batch_id: write(batch.drop(source), batch_id)
        write = closing_sink(plain, view, event_time, markers, f"{checkpoint}/reached", lateness, source)
    return for_each_batch(sdf, write, checkpoint, available_now, interval)


def dataset_sink(sdf: DataFrame, view: View | str, event_time: str | None = None) -> Callable[[DataFrame, int], None]:
    """What :func:`stream_to_dataset` does with a batch of ``sdf``."""
    view = as_view(view)
    values = part_values(sdf, view, event_time)
    order = [*(part for part in view.parts if part not in BATCH_PARTS), *BATCH_PARTS]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = with_batch(batch.withColumns(values), batch_id)
        overwrite_slots(rows if len(order) == len(BATCH_PARTS) else cluster_by_slot(rows, order), view.dataset(), order)

    return write_batch


def part_values(sdf: DataFrame, view: View, event_time: str | None) -> dict[str, Column]:
    """Partition columns that a stream's rows lack, and the values they get."""
    values = {part: view.slot_value(part) for part in view.constraints}
    times = dict(zip(TIME_PARTS, TIME_PARTS, strict=True)) if event_time is not None else {}
    for part in view.parts:
        if part in values or part in sdf.columns or part in BATCH_PARTS:
            continue
        if part not in times:
            raise ValueError(f"{view.uri}: nothing gives the partition column {part}")
        values[part] = time_parts(F.col(event_time))[part]
    if set(values) - set(view.parts):
        raise ValueError(f"{view.uri}: {', '.join(sorted(set(values) - set(view.parts)))} is no partition column")
    return values


def stream_to_topic(sdf: DataFrame, topic: Topic, checkpoint: str, available_now: bool = False,
                    interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Send each batch to a topic. A broker may see a replayed batch twice; a folder topic keeps it once."""
    messages = to_messages(sdf, topic)
    if topic.format == "kafka":
        return (messages.writeStream.format("kafka").option("topic", topic.name).options(**topic.options)
                .option("checkpointLocation", checkpoint).trigger(**_trigger(available_now, interval)).start())

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        send_to_folder(with_batch(batch, batch_id), topic)

    return for_each_batch(messages, write_batch, checkpoint, available_now, interval)


def topic_sink(sdf: DataFrame, topic: Topic) -> Callable[[DataFrame, int], None]:
    """What :func:`stream_to_topic` does with a batch of ``sdf``, for a stream with further outputs."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        messages = to_messages(batch, topic)
        if topic.format == "kafka":
            messages.write.format("kafka").option("topic", topic.name).options(**topic.options).save()
        else:
            send_to_folder(with_batch(messages, batch_id), topic)

    return write_batch


def with_batch(batch: DataFrame, batch_id: int) -> DataFrame:
    """A micro-batch with its partition columns; written by overwrite, a batch without rows leaves no folder.

    The query's id lives in the checkpoint: a stream begun anew counts from batch 0 again, under another id,
    and does not touch the batches of the old one.
    """
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query_id:
        raise ValueError("with_batch must be called from a streaming query")
    return batch.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("long")})
