"""Runs as of many slots, runs with several outputs, and runs that break."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators import positions
from slotwise.operators.as_of import running_totals
from slotwise.operators.positions import reconcile_in_order, with_positions
from slotwise.operators.readiness import mark_views, ready_marks, withdraw_marks
from slotwise.plans.jobs import Job, backfill, finish_runs, run_at, run_stream
from slotwise.plans.runs import broken_runs, emit, new_run
from slotwise.session import path_exists
from slotwise.sources.datasets import View, read_dataset
from slotwise.sources.topics import Topic, read_topic, write_topic

START = dt.datetime(2024, 1, 1)
HOLES = "?year=${YEAR}&month=${MONTH}&day=${DAY}&hour=${HOUR}"
HOUR = ("year", "month", "day", "hour")
EVENT = T.StructType().add("id", "long").add("user_id", "integer").add("ts", "timestamp_ntz")


def rows(n=200, seed=1):
    draw = random.Random(seed)
    return [(i, draw.choice([None, 1, 1, 1, 2, 3]), START + dt.timedelta(seconds=30 * draw.randrange(-2000, 9000))) for i in range(n)]


def slot_frame(spark, times):
    return spark.createDataFrame([(t,) for t in times], "nominal_time timestamp_ntz")


# As of


@pytest.mark.parametrize("inclusive,block", [(False, 1024), (False, 7), (True, 1), (True, 16)])
def test_running_totals_are_those_of_each_slot_by_itself(spark, inclusive, block):
    draw = random.Random(block)
    slots = sorted({START + dt.timedelta(minutes=draw.randrange(6000)) for _ in range(40)})
    events = rows() + [(900, 9, None), (901, 4, slots[3])]
    found = running_totals(spark.createDataFrame(events, EVENT), slot_frame(spark, slots), ["user_id"], "ts",
                           {"n": F.lit(1).cast("bigint"), "ids": F.col("id")}, inclusive, block)
    wanted = []
    for t in slots:
        seen = {}
        for id_, user, ts in events:
            if ts is not None and (ts < t or (inclusive and ts == t)):
                n, ids = seen.get(user, (0, 0))
                seen[user] = n + 1, ids + id_
        wanted += [(user, *totals, t) for user, totals in seen.items()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(wanted, key=str)


def test_a_hot_key_is_cut_into_blocks(spark):
    """One user has most rows, and more slots than a block holds."""
    minutes = [START + dt.timedelta(minutes=m) for m in range(300)]
    events = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).cast("int").alias("user_id"),
                                      F.timestamp_add("SECOND", (F.col("id") * 7 % 18000).cast("int"), F.lit(str(START)).cast("timestamp_ntz")).alias("ts"))
    found = running_totals(events, slot_frame(spark, minutes), ["user_id"], "ts", block=16).where("user_id = 1")
    of_one = sorted(r.ts for r in events.where("user_id = 1").collect())
    wanted = {t: sum(ts < t for ts in of_one) for t in minutes}
    assert {r.nominal_time: r.event_count for r in found.collect()} == {t: n for t, n in wanted.items() if n}


def test_no_slots_and_no_rows(spark):
    events, slots = spark.createDataFrame(rows(5), EVENT), slot_frame(spark, [START])
    assert running_totals(events, slots.limit(0), ["user_id"], "ts").collect() == []
    assert running_totals(events.limit(0), slots, ["user_id"], "ts").collect() == []


def test_a_backfill_as_of_gives_what_runs_slot_by_slot_give(spark, folder):
    source = View("dataset:" + folder("events"), EVENT)
    spark.createDataFrame(rows(), EVENT).write.parquet(source.parsed.location)
    report = Job("report", lambda events, slots: running_totals(events, slots, ["user_id"], "ts"), {"events": None}, {"report": None})
    whole, single = (View("dataset:" + folder(n), T.StructType().add("user_id", "integer").add("event_count", "long"), HOUR) for n in "ab")
    times = [START + dt.timedelta(hours=h) for h in (1, 5, 24, 70)]
    backfill(spark, report, slot_frame(spark, times), {"events": source}, {"report": View(whole.uri + HOLES, whole.schema, HOUR)})
    for t in times:
        run_at(spark, report, t, {"events": source}, {"report": View(single.uri + HOLES, single.schema, HOUR)})
    given, wanted = (sorted(map(str, read_dataset(spark, v).select("user_id", "event_count", *HOUR).collect())) for v in (whole, single))
    assert given == wanted and given


def test_a_whole_dataset_needs_a_job_that_asks_for_slots(spark, folder):
    copy = Job("copy", lambda events: events, {"events": None}, {"out": None})
    with pytest.raises(ValueError, match="asks for slots"):
        backfill(spark, copy, slot_frame(spark, [START]), {"events": View("dataset:" + folder("events"), EVENT)},
                 {"out": View("dataset:" + folder("out") + HOLES, EVENT, HOUR)})


# Several outputs


def dataset(folder, name, schema=EVENT):
    return View("dataset:" + folder(name), schema, HOUR)


def hourly(view):
    return View(view.uri + HOLES, view.schema, view.parts)


def written(spark, folder):
    """Events filed by hour, and their hours."""
    source = dataset(folder, "events")
    hour = spark.createDataFrame(rows(), EVENT).withColumns({p: F.expr(f"{p if p != 'day' else 'dayofmonth'}(ts)") for p in HOUR})
    hour.write.partitionBy(*HOUR).parquet(source.parsed.location)
    return source, hour.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("nominal_time")).distinct()


def counting(spark, counter):
    @F.udf("boolean")
    def seen(_):
        counter.add(1)
        return True

    return seen.asNondeterministic()


def split_job(spark, counter, name="split", fail=False):
    def split(events):
        seen = events.where(counting(spark, counter)(F.col("id")))
        odd = F.col("user_id") % 2 == 1
        if fail:
            odd = F.when(F.col("id") == 7, F.raise_error("broken")).otherwise(odd)
        return emit(seen, odd=odd, even=F.col("user_id") % 2 == 0, ids=(["id", "nominal_time"], None))

    return Job(name, split, {"events": None}, {"odd": None, "even": None, "ids": None})


def test_input_rows_are_read_once_for_all_outputs(spark, folder):
    source, slots = written(spark, folder)
    counter = spark.sparkContext.accumulator(0)
    targets = {"odd": dataset(folder, "odd"), "even": dataset(folder, "even"), "ids": dataset(folder, "ids", T.StructType().add("id", "long"))}
    backfill(spark, split_job(spark, counter), slots, {"events": hourly(source)}, {n: hourly(v) for n, v in targets.items()})
    assert counter.value == 200
    found = {n: sorted(r.id for r in read_dataset(spark, v).collect()) for n, v in targets.items()}
    assert found == {"odd": [i for i, u, _ in rows() if u and u % 2], "even": [i for i, u, _ in rows() if u and u % 2 == 0],
                     "ids": list(range(200))}
    run_at(spark, split_job(spark, counter), slots.first()[0], {"events": hourly(source)}, {n: hourly(v) for n, v in targets.items()})
    assert sorted(r.id for r in read_dataset(spark, targets["ids"]).collect()) == list(range(200))


def test_messages_of_a_stream_are_read_once(spark, folder, tmp_path):
    topic = Topic(f"{tmp_path}/topic", EVENT)
    write_topic(spark.createDataFrame(rows(), EVENT), topic)
    both = Job("both", lambda arriving: emit(arriving, odd=F.col("user_id") % 2 == 1, passed=(["id"], None)),
               {"arriving": None}, {"odd": None, "passed": None})
    odd, passed = View("dataset:" + folder("odd"), EVENT), Topic(f"{tmp_path}/passed", T.StructType().add("id", "long"))
    for _ in range(2):
        (running,) = run_stream(spark, both, {"arriving": topic}, {"odd": odd, "passed": passed}, f"{tmp_path}/check", available_now=True)
        running.awaitTermination()
    assert sum(p.numInputRows for p in running.recentProgress) == 0
    assert sorted(r.id for r in read_topic(spark, passed).collect()) == list(range(200))
    assert sorted(r.id for r in read_dataset(spark, odd).collect()) == [i for i, u, _ in rows() if u and u % 2]


def test_a_run_that_breaks_before_its_outputs_are_staged_changes_nothing(spark, folder):
    source, slots = written(spark, folder)
    targets = {"odd": dataset(folder, "odd"), "even": dataset(folder, "even"), "ids": dataset(folder, "ids", T.StructType().add("id", "long"))}
    markers, counter = View("dataset:" + folder("marks")), spark.sparkContext.accumulator(0)
    outputs = {n: hourly(v) for n, v in targets.items()}
    backfill(spark, split_job(spark, counter, "early"), slots, {"events": hourly(source)}, outputs, markers)
    marked = ready_marks(spark, markers, targets["odd"].marks).count()
    with pytest.raises(PySparkException, match="broken"):
        backfill(spark, split_job(spark, counter, "early", fail=True), slots, {"events": hourly(source)}, outputs, markers)
    assert ready_marks(spark, markers, targets["odd"].marks).count() == marked > 0
    assert read_dataset(spark, targets["ids"]).count() == 200
    assert broken_runs(spark, "early") == []


def test_a_run_that_breaks_while_placing_is_finished_without_computing_again(spark, folder, tmp_path):
    source, slots = written(spark, folder)
    (tmp_path / "even").write_text("a file where the second output's folder should be")
    targets = {"odd": dataset(folder, "odd"), "even": dataset(folder, "even"), "ids": dataset(folder, "ids", T.StructType().add("id", "long"))}
    markers, counter = View("dataset:" + folder("marks")), spark.sparkContext.accumulator(0)
    mark_views(slots.select(F.lit(targets["odd"].marks).alias("view"), "nominal_time"), markers)
    split = split_job(spark, counter, "late")
    with pytest.raises(Exception):
        backfill(spark, split, slots, {"events": hourly(source)}, {n: hourly(v) for n, v in targets.items()}, markers)
    assert [ready_marks(spark, markers, v.marks).count() for v in targets.values()] == [0, 0, 0]
    assert len(broken_runs(spark, "late")) == 1
    (tmp_path / "even").unlink()
    assert finish_runs(spark, split) == 1 and finish_runs(spark, split) == 0
    assert counter.value == 200
    assert read_dataset(spark, targets["ids"]).count() == 200 and read_dataset(spark, targets["even"]).count() > 0
    n = slots.count()
    assert [ready_marks(spark, markers, v.marks).count() for v in targets.values()] == [n, n, n]


def test_a_run_under_way_is_not_taken_for_a_broken_one(spark):
    with new_run(spark, "busy") as run:
        run.note(names=[])
        assert broken_runs(spark, "busy") == []
    assert broken_runs(spark, "busy") == []


def test_withdrawn_marks(spark, folder):
    markers = View("dataset:" + folder("marks"))
    times = [START + dt.timedelta(hours=h) for h in range(6)]
    for view, part in (("a", times), ("a", times[:2]), ("b", times)):
        mark_views(slot_frame(spark, part).select(F.lit(view).alias("view"), "nominal_time"), markers)
    withdraw_marks(slot_frame(spark, times[1:3]), ["a", "none"], markers)
    assert sorted(r[0] for r in ready_marks(spark, markers, "a").collect()) == [times[0], *times[3:]]
    assert ready_marks(spark, markers, "b").count() == 6
    withdraw_marks(slot_frame(spark, times), ["a"], markers)
    assert ready_marks(spark, markers, "a").count() == 0
    withdraw_marks(slot_frame(spark, times), ["a"], markers)


# Records


REQUIRED = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("name", T.StringType(), False)]), False)),
    T.StructField("sizes", T.MapType(T.StringType(), T.LongType(), False)),
    T.StructField("at", T.StructType([T.StructField("x", T.LongType(), False), T.StructField("y", T.LongType())])),
])
LOOSE = "id bigint, tags array<struct<name: string>>, sizes map<string, bigint>, at struct<x: bigint, y: bigint>, more string"


@pytest.mark.parametrize("row,offender", [
    ((1, [("a",)], {"k": 1}, (1, None), None), None),
    ((1, None, None, None, None), None),
    ((1, [], {}, (1, None), "x"), None),
    ((None, [("a",)], None, None, "x"), "id"),
    ((1, [("a",), None], None, None, "x"), "tags[]"),
    ((1, [("a",), (None,)], None, None, "x"), "tags[].name"),
    ((1, None, {"k": None}, None, "x"), "sizes{}"),
    ((1, None, None, (None, 2), "x"), "at.x"),
])
def test_required_fields(spark, folder, row, offender):
    given = spark.createDataFrame([(5, None, None, None, None), row], LOOSE)
    keep = Job("keep", lambda slots: given, {}, {"kept": REQUIRED})
    target = View("dataset:" + folder("kept"), T.StructType([*REQUIRED.fields, T.StructField("more", T.StringType())]))
    if offender is None:
        run_at(spark, keep, START, {}, {"kept": target})
        assert read_dataset(spark, target).count() == 2
        return
    with pytest.raises(PySparkException) as failure:
        run_at(spark, keep, START, {}, {"kept": target})
    assert f"output kept of job keep: {offender} is NULL in" in str(failure.value)
    assert not path_exists(spark, target.parsed.location) or read_dataset(spark, target).isEmpty()


def test_required_fields_of_emitted_outputs(spark, folder):
    given = spark.createDataFrame([(1, "a"), (None, "b")], "id bigint, name string")
    strict = T.StructType([T.StructField("id", T.LongType(), False)])
    both = Job("both", lambda slots: emit(given, names=(["name"], None), ids=(["id"], F.col("name") == "b")), {}, {"names": None, "ids": strict})
    names, ids = (View("dataset:" + folder(n)) for n in ("names", "ids"))
    with pytest.raises(PySparkException, match="output ids of job both: id is NULL in"):
        run_at(spark, both, START, {}, {"names": names, "ids": ids})


# Order


def test_positions_are_gapless_and_in_order(spark):
    given = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("key"), F.lit("same").alias("_row")).repartition(7)
    found = with_positions(given, [F.col("key").desc(), "id"])
    assert found.columns == ["id", "key", "_row", "position"]
    rows_ = sorted(found.collect(), key=lambda r: r.position)
    assert [r.position for r in rows_] == list(range(5000))
    assert [(r.key, r.id) for r in rows_] == sorted(((r.key, r.id) for r in rows_), key=lambda x: (-x[0], x[1]))
    assert with_positions(given.limit(0), ["id"]).collect() == []


def test_rows_that_tie_are_spread(spark):
    given = spark.range(4000).select(F.lit(1).alias("key"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = with_positions(given.repartition(8), ["key"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) > 4 and max(r[1] for r in found) < 2000
    assert positions.PLACE_BITS == 33


def test_reconcile_in_order(spark):
    sent = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "turn int, what string")
    arrived = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "d"), (5, "e")], "turn int, what string")
    found = reconcile_in_order(sent, arrived, ["turn"])
    assert sorted((r.position, r.expected and r.expected.what, r.actual and r.actual.what) for r in found.collect()) == [
        (1, "b", None), (2, None, "b"), (4, None, "e")]
    assert reconcile_in_order(sent, sent, ["turn"]).collect() == []
