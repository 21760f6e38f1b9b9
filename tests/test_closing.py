"""Slots that streams close: partitions that lag, late rows, replayed batches, silent hours."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slotwise.functions.timeparts import parts_upto
from slotwise.operators.readiness import ready_marks
from slotwise.sources.datasets import View
from slotwise.schemas import EVENT
from slotwise.streaming.closing import closing_sink

HOUR = parts_upto("hour")


@pytest.fixture
def stream(spark, folder):
    """Feeds batches to a sink that writes nothing; tells which hours are marked after each."""
    view, markers = View("dataset:" + folder("streamed"), EVENT, HOUR), folder("markers")
    markers = View("dataset:" + markers)
    seen = []

    def feed(batch_id, *rows, **options):
        def write(batch, number):
            seen.append((number, marked(), batch.count()))

        options = {"source": "part", **options}
        sink = closing_sink(write, view, "ts", markers, folder("progress"), **options)
        batch = spark.createDataFrame(list(rows), "part int, at string").select("part", F.col("at").cast("timestamp_ntz").alias("ts"))
        sink(batch, batch_id)
        return marked()

    def marked():
        return sorted(r[0].hour for r in ready_marks(spark, markers, view.marks).collect())

    feed.seen = seen
    return feed


def at(hour, minute=30):
    return f"2024-01-01 {hour:02}:{minute:02}:00"


def test_the_partition_that_lags_holds_the_time(stream):
    assert stream(0, (1, at(1)), (2, at(5))) == []
    assert stream(1, (1, at(3))) == [1, 2]
    assert stream(2, (2, at(9))) == [1, 2]
    # Hours without rows are closed too; time never goes back.
    assert stream(3, (1, at(7))) == [1, 2, 3, 4, 5, 6]
    assert stream(4, (1, at(7, 10)), (2, at(7, 10))) == [1, 2, 3, 4, 5, 6]


def test_late_rows_withdraw_before_they_are_written(stream):
    stream(0, (1, at(1)), (1, at(6)))
    assert stream(1, (1, at(2)), (1, at(2, 40)), (1, at(4))) == [1, 3, 5]
    assert stream.seen[-1] == (1, [1, 3, 5], 3)
    assert stream(2, (1, at(6, 50))) == [1, 3, 5]
    assert stream(3, (1, at(3))) == [1, 5]
    # The next slot that closes closes the others again, but for one that gets rows in the same batch.
    assert stream(4, (1, at(7)), (1, at(4))) == [1, 2, 3, 5, 6]
    assert stream(5, (1, at(8))) == [1, 2, 3, 4, 5, 6, 7]


def test_a_replayed_batch_changes_nothing(stream):
    stream(0, (1, at(1)), (1, at(4)))
    once = stream(1, (1, at(2)), (1, at(4, 50)))
    assert once == [1, 3] == stream(1, (1, at(2)), (1, at(4, 50)))
    after = stream(2, (1, at(5)))
    assert after == [1, 2, 3, 4] == stream(2, (1, at(5)))


def test_lateness_and_rows_without_time(stream):
    assert stream(0, (1, at(1)), (1, None), (1, at(4)), lateness="1 hour") == [1, 2]
    assert stream(1, lateness="1 hour") == [1, 2]
    assert stream(2, (3, None), lateness="1 hour") == [1, 2]
    assert stream(3, (1, at(6)), source=None, lateness="1 hour") == [1, 2]


def test_a_stream_without_rows_marks_nothing(stream):
    assert stream(0) == [] and stream(1, (None, at(2))) == [] and stream(2, (None, at(3, 0))) == [2]


def test_a_view_without_time_parts_is_refused(folder):
    with pytest.raises(ValueError, match="no partition column"):
        closing_sink(lambda b, i: None, View("dataset:" + folder("d"), EVENT), "ts", folder("m"), folder("p"))
