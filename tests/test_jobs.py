"""Jobs run for one slot, for many, by schedule and again."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.timeparts import parts_upto
from slotwise.operators.readiness import mark_ready, ready_marks
from slotwise.operators.sinks import write_time_partitioned
from slotwise.operators.transforms import count_by_key, odd_users, union_inputs
from slotwise.plans.jobs import Job, Schedule, backfill, job, run_at, run_schedules
from slotwise.plans.settings import output_settings
from slotwise.schemas import EVENT, KEY_VALUES, REPORT, TIME_PARTS
from slotwise.sources.datasets import View, covering_partitions, read_dataset, read_view
from slotwise.sources.generator import generate_events
from tests.test_datasets import HOUR, HOUR_HOLES, MINUTE_HOLES, USER, database, users  # noqa: F401

FIRST = dt.datetime(2015, 5, 7, 12)


@job("example-data-generator", inputs=[], outputs={"example_events": EVENT})
def generator(slots):
    return generate_events(slots)


@job("odd-users", inputs={"example_events": EVENT}, outputs={"odd_users": EVENT})
def keep_odd(example_events):
    return odd_users(example_events)


@job("report", inputs=["example_events"], outputs={"report": REPORT})
def report(example_events):
    return {"report": count_by_key(example_events, "user_id")}


@job("slot-report", inputs=["example_events"], outputs={"report": REPORT})
def slot_report(example_events):
    return count_by_key(example_events, "nominal_time", "user_id")


def minutes(n):
    return [FIRST + dt.timedelta(minutes=i) for i in range(n)]


def slot_table(spark, times):
    return spark.createDataFrame([(t.isoformat(),) for t in times], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("nominal_time"))


def by_minute(folder, name, schema=EVENT):
    return View("view:" + folder(name) + MINUTE_HOLES, schema, TIME_PARTS)


def markers_of(folder):
    return View("dataset:" + folder("markers"))


def test_generate_then_report(spark, folder):
    """Five minutes of ten events, then a report over everything: ten users with five events each."""
    for t in minutes(5):
        run_at(spark, generator, t, {}, {"example_events": by_minute(folder, "events")})
    run_at(spark, report, FIRST + dt.timedelta(minutes=5), {"example_events": by_minute(folder, "events").dataset()},
           {"report": by_minute(folder, "report", REPORT)})
    rows = read_dataset(spark, by_minute(folder, "report", REPORT)).collect()
    assert len(rows) == 10 and {r.event_count for r in rows} == {5}
    assert {(r.hour, r.minute) for r in rows} == {(12, 5)}


def test_odd_users_per_minute(spark, folder):
    for t in minutes(2):
        run_at(spark, generator, t, {}, {"example_events": by_minute(folder, "events")})
        run_at(spark, keep_odd, t, {"example_events": by_minute(folder, "events")},
               {"odd_users": by_minute(folder, "odd")})
        rows = read_view(spark, by_minute(folder, "odd").at(t)).orderBy("user_id").collect()
        assert [r.user_id for r in rows] == [1, 3, 5, 7, 9]
        assert {r.timestamp for r in rows} == {t}


def test_dynamic_job(spark, folder):
    from slotwise.operators.sinks import write_view
    noon = "2015-05-15T12:00Z"
    views = {name: View("view:" + folder(name) + HOUR_HOLES, USER, HOUR) for name in ("input1", "input2", "output")}
    write_view(users(spark, 10), views["input1"].at(noon))
    write_view(users(spark, 10, 10), views["input2"].at(noon))
    merge = Job("merge", lambda **inputs: union_inputs(inputs), inputs=None, outputs={"output": USER})
    run_at(spark, merge, noon, {k: views[k] for k in ("input1", "input2")}, {"output": views["output"]})
    out = read_dataset(spark, views["output"])
    assert sorted(r.user_id for r in out.collect()) == list(range(20))
    assert covering_partitions(out, HOUR).count() == 1


def test_settings_reach_the_job(spark, folder):
    @job("write-config", inputs=[], outputs={"kv": KEY_VALUES})
    def write_config(slots, settings):
        as_map = lambda d: F.create_map(*(F.lit(x) for item in d.items() for x in item))
        return slots.select(
            as_map(settings).alias("jobsettings"),
            F.lit(None).cast("map<string,string>").alias("inputsettings"),
            as_map(output_settings(settings, "kv")).alias("outputsettings"))

    target = View("dataset:" + folder("kv"), KEY_VALUES)
    run_at(spark, write_config, FIRST, {}, {"kv": target}, settings={
        "app.level": "appvalue", "job.write-config.job.level": "jobvalue",
        "job.write-config.output.kv.output.level": "outputvalue"})
    row = read_dataset(spark, target).first()
    assert row.jobsettings == {"app.level": "appvalue", "job.level": "jobvalue", "output.kv.output.level": "outputvalue"}
    assert row.outputsettings == {"app.level": "appvalue", "job.level": "jobvalue", "output.level": "outputvalue"}


def test_names_and_types_are_checked(spark, folder):
    views = {"example_events": by_minute(folder, "events")}
    out = {"odd_users": by_minute(folder, "odd")}
    with pytest.raises(ValueError, match="needs input example_events"):
        run_at(spark, keep_odd, FIRST, {}, out)
    with pytest.raises(ValueError, match="has no output bogus"):
        run_at(spark, keep_odd, FIRST, views, {**out, "bogus": out["odd_users"]})
    with pytest.raises(ValueError, match="needs output odd_users"):
        Schedule(keep_odd, "* * * * *", outputs={}, inputs=views)
    with pytest.raises(ValueError, match="must match"):
        Job("invalid.name.with.periods", lambda: {}, {}, {})
    with pytest.raises(ValueError, match="not a supported schedule"):
        Schedule(keep_odd, "0 0 * * 1", outputs=out, inputs=views)
    run_at(spark, generator, FIRST, {}, {"example_events": views["example_events"]})
    wrong = Job("wrong", lambda e: e, {"e": T.StructType().add("user_id", "string")}, {"o": None})
    with pytest.raises(TypeError, match="user_id should be string, is bigint"):
        run_at(spark, wrong, FIRST, {"e": views["example_events"]}, {"o": by_minute(folder, "odd")})
    lost = Job("lost", lambda e: {"other": e}, {"e": None}, {"o": None})
    with pytest.raises(ValueError, match="has no output other"):
        run_at(spark, lost, FIRST, {"e": views["example_events"]}, {"o": by_minute(folder, "odd")})


def test_marks_follow_success(spark, folder):
    markers, target = markers_of(folder), by_minute(folder, "events")
    assert ready_marks(spark, markers, target.marks).count() == 0
    run_at(spark, generator, FIRST, {}, {"example_events": target}, markers)
    run_at(spark, generator, FIRST, {}, {"example_events": target}, markers)
    assert [r.nominal_time for r in ready_marks(spark, markers, target.marks).collect()] == [FIRST]

    nothing = Job("nothing", lambda slots: generate_events(slots).where("user_id < 0"), {}, {"o": EVENT})
    run_at(spark, nothing, FIRST, {}, {"o": by_minute(folder, "empty")}, markers)
    assert ready_marks(spark, markers, by_minute(folder, "empty").marks).count() == 1

    failing = Job("failing", lambda slots: generate_events(slots).withColumn(
        "session_id", F.raise_error(F.lit("broken"))), {}, {"o": None})
    with pytest.raises(Exception, match="broken"):
        run_at(spark, failing, FIRST, {}, {"o": by_minute(folder, "failed")}, markers)
    assert ready_marks(spark, markers, by_minute(folder, "failed").marks).count() == 0


def test_backfill_equals_single_runs(spark, folder):
    times = minutes(4)
    backfill(spark, generator, slot_table(spark, times + times[:1]), {}, {"example_events": by_minute(folder, "events")})
    assert read_dataset(spark, by_minute(folder, "events")).count() == 40
    for j, name, schema in ((keep_odd, "odd_users", EVENT), (slot_report, "report", REPORT)):
        for t in times[1:3]:
            run_at(spark, j, t, {"example_events": by_minute(folder, "events")},
                   {name: by_minute(folder, f"{j.name}-one", schema)})
        backfill(spark, j, slot_table(spark, times[1:3]), {"example_events": by_minute(folder, "events")},
                 {name: by_minute(folder, f"{j.name}-all", schema)})
        one = read_dataset(spark, by_minute(folder, f"{j.name}-one", schema))
        many = read_dataset(spark, by_minute(folder, f"{j.name}-all", schema))
        assert one.count() > 0 and one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_backfill_shares_a_coarse_input(spark, folder):
    """Four minutes read the same hour of input; each gets all of its rows."""
    hourly_events = View("view:" + folder("events") + HOUR_HOLES, EVENT, HOUR)
    run_at(spark, generator, FIRST, {}, {"example_events": hourly_events})
    backfill(spark, slot_report, slot_table(spark, minutes(4)), {"example_events": hourly_events},
             {"report": by_minute(folder, "report", REPORT)})
    rows = read_dataset(spark, by_minute(folder, "report", REPORT)).groupBy("minute").count().collect()
    assert {r.minute: r["count"] for r in rows} == {0: 10, 1: 10, 2: 10, 3: 10}


def test_backfill_again_clears_slots_that_came_out_empty(spark, folder):
    events, out = by_minute(folder, "events"), by_minute(folder, "out")
    backfill(spark, generator, slot_table(spark, minutes(4)), {}, {"example_events": events})
    copy = Job("copy", lambda e: e, {"e": EVENT}, {"o": EVENT})
    late = Job("late", lambda e: e.where(F.minute("nominal_time") >= 2), {"e": EVENT}, {"o": EVENT})
    backfill(spark, copy, slot_table(spark, minutes(4)), {"e": events}, {"o": out})
    # Only slots 0 to 2 are run again: 0 and 1 come out empty, 3 is left alone.
    backfill(spark, late, slot_table(spark, minutes(3)), {"e": events}, {"o": out}, markers_of(folder))
    counts = {r.minute: r["count"] for r in read_dataset(spark, out).groupBy("minute").count().collect()}
    assert counts == {2: 10, 3: 10}
    assert not os.path.exists(folder("out").removeprefix("file:") + "/year=2015/month=5/day=7/hour=12/minute=0")
    assert ready_marks(spark, markers_of(folder), out.marks).count() == 3


def test_backfill_on_catalog_tables(spark, database):  # noqa: F811
    from slotwise.sources.datasets import ensure_dataset
    uris = {name: f"hive:{database}/{name}" for name in ("events", "out")}
    for uri in uris.values():
        ensure_dataset(spark, View("dataset:" + uri, EVENT, TIME_PARTS))
    events, out = (View("view:" + uris[name] + MINUTE_HOLES, EVENT, TIME_PARTS) for name in ("events", "out"))
    backfill(spark, generator, slot_table(spark, minutes(3)), {}, {"example_events": events})
    assert read_view(spark, events.at(FIRST)).count() == 10
    copy = Job("copy", lambda e: e, {"e": EVENT}, {"o": EVENT})
    late = Job("late", lambda e: e.where(F.minute("nominal_time") >= 2), {"e": EVENT}, {"o": EVENT})
    for j in (copy, late):
        backfill(spark, j, slot_table(spark, minutes(3)), {"e": events}, {"o": out})
    assert {r.minute for r in read_dataset(spark, out).select("minute").distinct().collect()} == {2}
    # Slots outside the run stay, also in a session whose overwrites would empty them; its setting stays too.
    backfill(spark, generator, slot_table(spark, minutes(6)[5:]), {}, {"example_events": events})
    assert read_dataset(spark, events).count() == 40
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        backfill(spark, generator, slot_table(spark, minutes(1)), {}, {"example_events": events})
        assert read_dataset(spark, events).count() == 40
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_backfill_refuses_what_it_cannot_split(spark, folder):
    run_at(spark, generator, FIRST, {}, {"example_events": by_minute(folder, "events")})
    slots = slot_table(spark, minutes(2))
    with pytest.raises(ValueError, match="input example_events: a backfill needs time holes"):
        backfill(spark, report, slots, {"example_events": by_minute(folder, "events").dataset()},
                 {"report": by_minute(folder, "report", REPORT)})
    with pytest.raises(ValueError, match="must keep the column nominal_time"):
        backfill(spark, report, slots, {"example_events": by_minute(folder, "events")},
                 {"report": by_minute(folder, "report", REPORT)})
    with pytest.raises(ValueError, match="output report: a backfill needs time holes"):
        backfill(spark, slot_report, slots, {"example_events": by_minute(folder, "events")},
                 {"report": by_minute(folder, "report", REPORT).dataset()})
    backfill(spark, slot_report, slots.where("false"), {"example_events": by_minute(folder, "events")},
             {"report": by_minute(folder, "report", REPORT)})
    assert not os.path.exists(folder("report").removeprefix("file:"))


def test_backfill_reads_only_the_folders_of_its_slots(spark, folder):
    from slotwise.plans import jobs
    events = by_minute(folder, "events")
    times = minutes(6) + [FIRST + dt.timedelta(days=400)]
    backfill(spark, generator, slot_table(spark, times), {}, {"example_events": events})
    slots = slot_table(spark, times[2:4])
    rows = jobs._slot_rows(slots, jobs.Bounds.of(slots), "e", events)
    assert rows.count() == 20
    # Only the hour that both slots share is listed, and only their minutes are read.
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scans = rows._jdf.queryExecution().explainString(formatted)
    filters = next(line for line in scans.splitlines() if line.startswith("PartitionFilters"))
    assert "make_timestamp_ntz(year" in filters
    assert len(rows.inputFiles()) == 6
    assert all("/year=2015/month=5/day=7/hour=12/" in name for name in rows.inputFiles())
    apart = jobs._slot_rows(slot_table(spark, times), jobs.Bounds.of(slot_table(spark, times)), "e", events)
    assert apart.count() == 70


def test_runs_of_days(spark):
    from slotwise.plans import jobs
    day = dt.date(2015, 5, 7)
    times = [dt.datetime(2015, 5, d, h) for d in (7, 8, 9, 12) for h in (1, 5)]
    bounds = jobs.Bounds.of(slot_table(spark, times))
    assert (bounds.first, bounds.last) == (times[0], times[-1])
    assert bounds.days == ((day, dt.date(2015, 5, 9)), (dt.date(2015, 5, 12), dt.date(2015, 5, 12)))
    assert jobs.Bounds.of(slot_table(spark, times).where("false")) is None
    runs = [(day + dt.timedelta(n), day + dt.timedelta(n)) for n in (0, 2, 9, 30)]
    assert jobs._merged(runs, 2) == [(runs[0][0], runs[2][1]), runs[3]]
    assert jobs._merged(runs, 4) == runs


def test_sparse_slots_prune_without_a_broadcast(spark, folder, monkeypatch):
    """Two days eleven months apart: the plan itself names them, however the slots are joined."""
    from slotwise.plans import jobs
    events = View("view:" + folder("events") + "?year=${YEAR}&month=${MONTH}&day=${DAY}", EVENT, parts_upto("day"))
    days = [dt.datetime(2015, 1, 1) + dt.timedelta(days=n) for n in range(0, 336, 12)]
    backfill(spark, generator, slot_table(spark, days), {}, {"example_events": events}, clustered=True)
    slots = slot_table(spark, [days[0], days[-1]])
    rows = jobs._slot_rows(slots, jobs.Bounds.of(slots), "e", events)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows.count() == 20
        plan = rows._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin" not in plan.toString()
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        filters = [x for x in rows._jdf.queryExecution().explainString(formatted).splitlines() if "PartitionFilters" in x]
        assert any("20150101" in x and "201511" in x for x in filters)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_slots_than_are_broadcast(spark, folder):
    """Beyond the bound the slots are joined by shuffle: the result is the same, and a hot slot is split."""
    from slotwise.plans import jobs
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {key: spark.conf.get(key) for key in changed}
    events = View("view:" + folder("events") + HOUR_HOLES, EVENT, HOUR)
    out = View("view:" + folder("out") + HOUR_HOLES, EVENT, HOUR)
    times = [FIRST + dt.timedelta(hours=i) for i in range(12)]
    rows = spark.range(0, 200_000, 1, 8).select(
        F.col("id").alias("user_id"), F.sha2(F.col("id").cast("string"), 256).alias("session_id"),
        (F.lit(FIRST.isoformat()).cast("timestamp_ntz") + F.make_dt_interval(
            hours=F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 12).cast("int")))).alias("timestamp"))
    # Many files for the hot hour, as it would have, so that there are parts to split it by.
    write_time_partitioned(rows, events.dataset(), "timestamp", "hour", clustered=True)
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        joined = jobs._slot_rows(slot_table(spark, times), jobs.Bounds.of(slot_table(spark, times)), "e", events)
        final = joined.select("session_id", "nominal_time")
        assert len(final.collect()) == 200_000
        assert "skew=true" in final._jdf.queryExecution().executedPlan().toString()
        copy = Job("copy", lambda e: e, {"e": EVENT}, {"o": EVENT})
        backfill(spark, copy, slot_table(spark, times), {"e": events}, {"o": out})
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    counts = {r.hour: r.event_count for r in count_by_key(read_dataset(spark, out), "hour").collect()}
    assert counts == {r.hour: r.event_count for r in count_by_key(read_dataset(spark, events), "hour").collect()}


def test_triggered_schedule(spark, folder):
    """The odd-users job follows the generator's marks: it runs each slot once, when its input is there."""
    markers, events, odd = markers_of(folder), by_minute(folder, "events"), by_minute(folder, "odd")
    generate = Schedule(generator, "* * * * *", outputs={"example_events": events})
    triggered = Schedule(keep_odd, "* * * * *", outputs={"odd_users": odd}, inputs={"example_events": events})
    window = ("2015-05-07T11:59Z", "2015-05-07T12:10Z")

    assert triggered.due(spark, markers, *window).count() == 0
    run_schedules(spark, [generate, triggered], FIRST, markers=markers)
    generate.backfill(spark, slot_table(spark, minutes(4)[1:]), markers=markers)
    due = triggered.due(spark, markers, *window)
    assert sorted(r.nominal_time for r in due.collect()) == minutes(4)[1:]
    triggered.backfill(spark, due, markers=markers)
    assert triggered.due(spark, markers, *window).count() == 0
    assert read_dataset(spark, odd).count() == 20


def test_due_looks_up_the_instance_of_a_slower_input(spark, folder):
    markers = markers_of(folder)
    events, odd = View("view:" + folder("events") + HOUR_HOLES, EVENT, HOUR), by_minute(folder, "odd")
    schedule = Schedule(keep_odd, "*/20 * * * *", outputs={"odd_users": odd}, inputs={"example_events": events},
                        input_crons={"example_events": "0 * * * *"})
    mark_ready(slot_table(spark, [dt.datetime(2015, 5, 7, 13)]), events.marks, markers)
    due = schedule.due(spark, markers, "2015-05-07T11:59Z", "2015-05-07T15:00Z")
    assert sorted(r.nominal_time for r in due.collect()) == [
        dt.datetime(2015, 5, 7, 13, m) for m in (0, 20, 40)]


def test_runs_read_the_instance_of_a_slower_input(spark, folder):
    """A daily input that arrives at six: runs before six read the day before. One run and many agree."""
    daily = View("view:" + folder("daily") + "?year=${YEAR}&month=${MONTH}&day=${DAY}", EVENT, parts_upto("day"))
    for day in (6, 7):
        run_at(spark, generator, dt.datetime(2015, 5, day), {}, {"example_events": daily})

    def schedule(name, **options):
        return Schedule(slot_report, "0 */3 * * *", outputs={"report": by_minute(folder, name, REPORT)},
                        inputs={"example_events": daily}, input_crons={"example_events": "0 6 * * *"}, **options)

    @job("first-event", inputs={"example_events": EVENT}, outputs=["report"])
    def days(example_events):
        return example_events.groupBy("nominal_time").agg(F.min("timestamp").alias("first"))

    times = [dt.datetime(2015, 5, 7, hour) for hour in (0, 3, 6, 9)]
    wanted = {t: dt.datetime(2015, 5, 6 if t.hour < 6 else 7) for t in times}
    for options in ({}, {"start_at": "2015-05-01T00:00Z"}):
        single = replace(schedule("unused"), job=days, outputs={"report": by_minute(folder, f"one{len(options)}", None)},
                         **options)
        for t in times:
            single.run_at(spark, t)
        many = replace(single, outputs={"report": by_minute(folder, f"many{len(options)}", None)})
        many.backfill(spark, slot_table(spark, times))
        for s in (single, many):
            rows = read_dataset(spark, s.outputs["report"]).collect()
            assert {dt.datetime(r.year, r.month, r.day, r.hour, r.minute): r.first for r in rows} == wanted

    for cron in ("*/7 * * * *", "0 12 */7 * *"):
        with pytest.raises(ValueError, match="needs start_at"):
            Schedule(slot_report, "0 * * * *", outputs=single.outputs, inputs={"example_events": daily},
                     input_crons={"example_events": cron})
    with pytest.raises(ValueError, match="no input other"):
        Schedule(slot_report, "0 * * * *", outputs=single.outputs, inputs={"example_events": daily},
                 input_crons={"other": "0 * * * *"})


def test_record_functions_in_a_job(spark, folder):
    """A job may call Python per batch where no expression does the work."""
    def shout(batches):
        for batch in batches:
            yield pd.DataFrame({"user_id": batch.user_id, "session_id": batch.session_id + "!",
                                "timestamp": batch.timestamp, "nominal_time": batch.nominal_time})

    schema = T.StructType([*EVENT.fields, T.StructField("nominal_time", T.TimestampNTZType())])
    mapped = Job("shout", lambda e: e.mapInPandas(shout, schema), {"e": EVENT}, {"o": EVENT})
    run_at(spark, generator, FIRST, {}, {"example_events": by_minute(folder, "events")})
    run_at(spark, mapped, FIRST, {"e": by_minute(folder, "events")}, {"o": by_minute(folder, "out")})
    rows = read_dataset(spark, by_minute(folder, "out")).collect()
    assert sorted(r.session_id for r in rows) == [f"{i}!" for i in range(10)]
    assert {r.timestamp for r in rows} == {FIRST}


def test_per_partition_side_effect(spark, tmp_path):
    """A sink of one's own: each partition hands its rows on as they come."""
    target = str(tmp_path)

    def send(rows):
        sent = [str(row.id) for row in rows]
        if sent:
            with open(f"{target}/{sent[0]}", "w") as out:
                out.write("\n".join(sent))

    spark.range(0, 20, 1, 4).foreachPartition(send)
    sent = [line for name in os.listdir(target) for line in open(f"{target}/{name}").read().split()]
    assert sorted(map(int, sent)) == list(range(20))


def test_parts_of_templates():
    view = View("view:file:/x?year=${YEAR}&day=${DAY}&region=eu")
    assert view.slot_parts == {"year": "year", "day": "day"}
    assert view.at("2015-05-07T12:00Z").constraints == {"year": "2015", "day": "7", "region": "eu"}
    assert parts_upto("hour") == HOUR


def test_a_failed_run_leaves_its_slot_as_it_was(spark, folder):
    target, markers = by_minute(folder, "events"), markers_of(folder)
    run_at(spark, generator, FIRST, {}, {"example_events": target}, markers)
    failing = Job("failing", lambda slots: generate_events(slots).withColumn(
        "user_id", F.when(F.col("user_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("user_id"))), {}, {"o": EVENT})
    with pytest.raises(Exception, match="no"):
        run_at(spark, failing, FIRST, {}, {"o": target}, markers)
    assert read_view(spark, target.at(FIRST)).count() == 10


def test_a_random_job_loses_no_row_and_keeps_no_old_one(spark, folder):
    """The write decides which slots are empty, not another evaluation of the job."""
    out = by_minute(folder, "out", T.StructType([*EVENT.fields, T.StructField("run", T.IntegerType())]))
    slots = slot_table(spark, minutes(60))

    def random_job(run):
        keep = Job("random", lambda slots: generate_events(slots).where((F.col("user_id") == 0) & (F.rand() < 0.5))
                   .withColumn("run", F.lit(run)), {}, {"o": None})
        backfill(spark, keep, slots, {}, {"o": out})
        return {r.minute: r.run for r in read_dataset(spark, out).select("minute", "run").collect()}

    first, second = random_job(1), random_job(2)
    assert set(first.values()) == {1} and set(second.values()) == {2}
    assert 10 < len(second) < 50 and set(second) != set(first)
    assert set(random_job(3).values()) == {3}


def test_a_job_is_run_once_also_when_it_is_run_again(spark, folder):
    events, out = by_minute(folder, "events"), by_minute(folder, "out")
    slots = slot_table(spark, minutes(3))
    backfill(spark, generator, slots, {}, {"example_events": events})
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    copy = Job("copy", lambda e: e.mapInPandas(counted, e.schema), {"e": EVENT}, {"o": EVENT})
    for run in (1, 2):
        backfill(spark, copy, slots, {"e": events}, {"o": out})
        assert seen.value == 30 * run
    assert read_dataset(spark, out).count() == 30


def test_work_files_are_removed(spark, folder):
    from slotwise.session import list_folders, shared_dir
    work = shared_dir(spark) + "/slotwise"
    before = list_folders(spark, work)
    for _ in range(2):
        backfill(spark, generator, slot_table(spark, minutes(2)), {}, {"example_events": by_minute(folder, "events")})
    assert list_folders(spark, work) == before


def test_marks_of_a_view_with_fixed_values(spark, folder):
    markers = markers_of(folder)
    kinds = T.StructType([*EVENT.fields, T.StructField("kind", T.StringType())])
    parts = ("kind", *parts_upto("day"))
    holes = "&year=${YEAR}&month=${MONTH}&day=${DAY}"
    view = lambda kind, slashes="": View(
        "view:" + folder("kinds").replace("file:", "file:" + slashes) + f"?kind={kind}" + holes, kinds, parts)
    made = Job("made", lambda slots: generate_events(slots).withColumn("kind", F.lit("a")), {}, {"o": None})
    run_at(spark, made, dt.datetime(2015, 5, 7), {}, {"o": view("a")}, markers)
    odd = View("view:" + folder("odd") + "?" + holes[1:], EVENT, parts_upto("day"))
    window = ("2015-05-06T23:00Z", "2015-05-09T00:00Z")
    for wanted, n in ((view("a"), 1), (view("a", "//"), 1), (view("b"), 0)):
        schedule = Schedule(keep_odd, "0 0 * * *", outputs={"odd_users": odd}, inputs={"example_events": wanted})
        assert schedule.due(spark, markers, *window).count() == n
    assert view("007").marks != view("7").marks
    assert View("view:hive:a/b?n=05&m=1").marks == View("view:hive:///a/b?m=01&n=5").marks == "hive:a/b?m=1&n=5"


def test_only_the_folders_of_the_views_asked_for_are_listed(spark, folder):
    from slotwise.operators.readiness import compact_marks, marks_of
    markers, slots = markers_of(folder), slot_table(spark, minutes(2))
    for name in ("file:/a b?x=1", "hive:b/c", "d"):
        for _ in range(3):
            mark_ready(slots, name, markers)
    one = marks_of(spark, markers, ["file:/a b?x=1"])
    files = one.inputFiles()
    assert one.count() == 2 and files and all("hive" not in f and "view=d" not in f for f in files)
    assert marks_of(spark, markers, ["d", "hive:b/c", "none"]).count() == 4
    compact_marks(spark, markers, ["d", "hive:b/c", "none"])
    assert len(marks_of(spark, markers, ["d"]).inputFiles()) < 3 and marks_of(spark, markers, ["d", "hive:b/c"]).count() == 4
    assert len(marks_of(spark, markers, ["file:/a b?x=1"]).inputFiles()) == len(files)


def test_settings_reach_the_reader(spark, folder):
    events = by_minute(folder, "events")
    run_at(spark, generator, FIRST, {}, {"example_events": events})
    settings = {"job.odd-users.input.example_events.hadoop.pathGlobFilter": "*.none"}
    run_at(spark, keep_odd, FIRST, {"example_events": events}, {"odd_users": by_minute(folder, "odd")}, settings=settings)
    assert not os.path.exists(folder("odd").removeprefix("file:") + "/year=2015")


def test_an_input_by_the_minute_within_hours_needs_a_start(spark, folder):
    for cron in ("*/20 9 * * *", "* */2 * * *"):
        with pytest.raises(ValueError, match="needs start_at"):
            Schedule(keep_odd, "0 * * * *", outputs={"odd_users": by_minute(folder, "odd")},
                     inputs={"example_events": by_minute(folder, "events")}, input_crons={"example_events": cron})
    with pytest.raises(ValueError, match="not a supported schedule"):
        Schedule(keep_odd, "*/99999999999 * * * *", outputs={"odd_users": by_minute(folder, "odd")},
                 inputs={"example_events": by_minute(folder, "events")})
