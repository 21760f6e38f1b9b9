"""Schedules against fixed vectors and against a minute-by-minute search."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotwise.functions.cron import (
    audit_schedules, next_fire, parse_cron, plain_step, slot_of, stride, stride_minutes, with_cron_fields,
)
from slotwise.functions.timeparts import nominal_literal
from slotwise.operators.slots import events_per_slot, fire_slots, instance_at, is_slot

# Schedule, stride, time, next slot.
VECTORS = [
    ("* * * * *", (1, "minutes"), "2015-06-10T23:42:37", "2015-06-10T23:43:00"),
    ("*/5 * * * *", (5, "minutes"), "2015-06-10T23:42:37", "2015-06-10T23:45:00"),
    ("*/5 * * * *", (5, "minutes"), "2015-06-10T23:56:37", "2015-06-11T00:00:00"),
    ("*/5 * * * *", (5, "minutes"), "2015-06-10T07:58:37", "2015-06-10T08:00:00"),
    ("0 * * * *", (1, "hours"), "2015-06-10T02:42:37.520", "2015-06-10T03:00:00"),
    ("5 * * * *", (1, "hours"), "2015-06-10T02:42:37.520", "2015-06-10T03:05:00"),
    ("0 * * * *", (1, "hours"), "2015-06-10T23:42:37", "2015-06-11T00:00:00"),
    ("0 1 * * *", (1, "days"), "2015-06-10T02:42:37.520", "2015-06-11T01:00:00"),
    ("30 9 * * *", (1, "days"), "2015-06-10T02:42:37.520", "2015-06-10T09:30:00"),
    ("0 12 */7 * *", (7, "days"), "2015-06-10T02:42:37.520", "2015-06-10T12:00:00"),
    ("0 12 */7 * *", (7, "days"), "2015-06-10T23:42:37.520", "2015-06-11T12:00:00"),
    ("*/5 * * * *", (5, "minutes"), "2015-06-10T23:45:00", "2015-06-10T23:50:00"),
    ("*/7 * * * *", (7, "minutes"), "2015-06-10T23:56:00", "2015-06-11T00:00:00"),
    ("0 * * * *", (1, "hours"), "2015-06-10T03:00:00", "2015-06-10T03:00:00"),
    ("17 */5 * * *", (5, "hours"), "2015-06-10T20:17:00.000001", "2015-06-11T00:17:00"),
]


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def times(spark, values):
    """Rows of (n, ts); written as text, for a datetime would pass through the machine's zone."""
    rows = [(i, v.isoformat()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def fires(cron: str, minute: dt.datetime) -> bool:
    """Whether a minute is a slot, read off the schedule the plain way."""
    minutes, hours = cron.split(" ")[:2]

    def hit(field: str, value: int) -> bool:
        return field == "*" or (value % int(field[2:]) == 0 if field.startswith("*/") else value == int(field))

    if minutes.startswith("*"):
        return hit(minutes, minute.minute)
    return hit(minutes, minute.minute) and hit(hours, minute.hour)


def search_next(cron: str, ts: dt.datetime, inclusive: bool) -> dt.datetime:
    minute = ts.replace(second=0, microsecond=0)
    stays = ts == minute and (inclusive or not cron.startswith("*"))
    if not stays:
        minute += dt.timedelta(minutes=1)
    while not fires(cron, minute):
        minute += dt.timedelta(minutes=1)
    return minute


def search_slot(cron: str, ts: dt.datetime) -> dt.datetime:
    minute = ts.replace(second=0, microsecond=0)
    while not fires(cron, minute):
        minute -= dt.timedelta(minutes=1)
    return minute


@pytest.mark.parametrize("as_column", [False, True])
def test_vectors(spark, as_column):
    rows = [(i, cron, ts) for i, (cron, _, ts, _) in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, "n int, cron string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    if as_column:
        got = [r.f for r in df.orderBy("n").select(next_fire(F.col("ts"), F.col("cron")).alias("f")).collect()]
    else:
        got = [df.where(F.col("n") == i).select(next_fire(F.col("ts"), v[0]).alias("f")).first().f
               for i, v in enumerate(VECTORS)]
    assert got == [at(v[3]) for v in VECTORS]


def test_strides(spark):
    for cron, wanted in {(v[0], v[1]) for v in VECTORS}:
        s, minutes = spark.range(1).select(stride(cron).alias("s"), stride_minutes(cron).alias("m")).first()
        assert tuple(s) == wanted
        assert minutes == wanted[0] * {"minutes": 1, "hours": 60, "days": 1440}[wanted[1]]


fields = st.one_of(st.just("*"), st.integers(1, 70).map("*/{}".format))
crons = st.one_of(
    st.tuples(fields, fields),
    st.tuples(st.integers(0, 59).map(str), fields),
    st.tuples(st.integers(0, 59).map(str), st.integers(0, 23).map(str)),
).map(lambda f: f"{f[0]} {f[1]} * * *")
instants = st.datetimes(dt.datetime(2015, 1, 1), dt.datetime(2017, 1, 1)).flatmap(
    lambda t: st.sampled_from([t, t.replace(second=0, microsecond=0), t.replace(minute=0, second=0, microsecond=0)]))


@settings(max_examples=8, deadline=None)
@given(cron=crons, values=st.lists(instants, min_size=30, max_size=30))
def test_against_search(spark, cron, values):
    df = times(spark, values).withColumn("cron", F.lit(cron))
    df, fields_ = with_cron_fields(df)
    ts = F.col("ts")
    rows = df.orderBy("n").select(
        next_fire(ts, cron).alias("a"), next_fire(ts, F.col("cron")).alias("b"), next_fire(ts, fields_).alias("c"),
        next_fire(ts, cron, inclusive=True).alias("d"),
        slot_of(ts, cron).alias("e"), slot_of(ts, fields_).alias("f")).collect()
    for row, value in zip(rows, values):
        wanted = search_next(cron, value, inclusive=False)
        assert (row.a, row.b, row.c) == (wanted, wanted, wanted)
        assert row.d == search_next(cron, value, inclusive=True)
        assert row.e == row.f == search_slot(cron, value)


@pytest.mark.parametrize("cron", ["*/5 * * * *", "*/7 * * * *", "0 * * * *", "17 */4 * * *", "17 */5 * * *",
                                  "30 9 * * *"])
def test_counts_use_the_same_slots_with_and_without_window(spark, cron):
    df = times(spark, [dt.datetime(2015, 3, 1) + dt.timedelta(seconds=997 * i) for i in range(400)])
    by_window = {r.nominal_time: r.event_count for r in events_per_slot(df, cron).collect()}
    by_formula = {r.s: r["count"] for r in df.groupBy(slot_of(F.col("ts"), cron).alias("s")).count().collect()}
    assert by_window == by_formula
    assert (plain_step(cron) is None) == (cron in ("*/7 * * * *", "17 */5 * * *"))


INVALID = ["0 * * *", "0 * * * * *", "1-5 * * * *", "* x * * *", "0 0 1,2 * *", "0 0 * 1 *", "0 0 * * 1", "*/0 * * * *",
           "0 */0 * * *", "60 * * * *", "0 24 * * *", "0 0 15 * *", "*/99999999999 * * * *", "0  * * *", ""]


def test_invalid_schedules(spark):
    for cron in INVALID:
        if cron != "*/99999999999 * * * *":
            with pytest.raises(ValueError):
                parse_cron(cron)
    df = audit_schedules(spark.createDataFrame([(c,) for c in INVALID], "cron string"))
    assert df.where("valid or reason is null or every is not null").count() == 0
    df = audit_schedules(spark.createDataFrame([(v[0],) for v in VECTORS] + [("0 * * * *  ",)], "cron string"))
    assert df.where("not valid or reason is not null or every is null").count() == 0
    assert audit_schedules(spark.createDataFrame([(None,)], "cron string")).first().reason == "needs five fields"


def test_invalid_schedule_in_a_column_has_no_slots(spark):
    df = spark.createDataFrame([(c,) for c in INVALID], "cron string").withColumn(
        "start_at", nominal_literal("2015-06-10T12:30")).withColumn("end_at", nominal_literal("2015-07-10T12:30"))
    ts, cron = F.col("start_at"), F.col("cron")
    with_fields, fields_ = with_cron_fields(df)
    for got in (
        df.select(F.coalesce(next_fire(ts, cron), slot_of(ts, cron)).alias("t"), is_slot(ts, cron).alias("s")),
        with_fields.select(F.coalesce(next_fire(ts, fields_), slot_of(ts, fields_)).alias("t"),
                           is_slot(ts, fields_).alias("s")),
    ):
        assert got.where("t is not null or s").count() == 0
    assert df.select(stride_minutes(cron).alias("m")).where("m is not null").count() == 0
    assert fire_slots(df).count() == 0


def test_fire_slots(spark):
    def slots(cron, start, end):
        one = spark.range(1).select(F.lit(cron).alias("cron"), nominal_literal(start).alias("start_at"),
                                    nominal_literal(end).alias("end_at"))
        return [r.nominal_time for r in fire_slots(one).orderBy("nominal_time").collect()]

    assert slots("0 * * * *", "2015-06-10T02:42:37.520", "2015-06-10T05:00") == [
        at("2015-06-10T03:00"), at("2015-06-10T04:00")]
    # The schedule stays on its first slot; one with minute steps moves on.
    assert slots("0 * * * *", "2015-06-10T03:00", "2015-06-10T04:00") == [at("2015-06-10T03:00")]
    assert slots("*/30 * * * *", "2015-06-10T03:00", "2015-06-10T04:00") == [at("2015-06-10T03:30")]
    assert len(slots("* * * * *", "2015-02-27T23:59", "2015-03-01T00:00")) == 1440
    # All fields count here: hours of a minute step, days from the first of the month.
    assert slots("*/30 9 * * *", "2015-06-10T00:00", "2015-06-11T00:00") == [
        at("2015-06-10T09:00"), at("2015-06-10T09:30")]
    assert [t.day for t in slots("0 12 */7 * *", "2015-06-01T00:00", "2015-07-01T00:00")] == [1, 8, 15, 22, 29]
    assert slots("0 * * * *", "2015-06-10T05:00", "2015-06-10T04:00") == []


def test_slots_and_instances_drift_apart(spark):
    """Slots of */7 start again each hour; the instances of its data keep a stride of seven minutes."""
    df = times(spark, [at("2015-06-10T00:56"), at("2015-06-10T01:00"), at("2015-06-10T01:07"), at("2015-06-09T23:59")])
    rows = df.orderBy("n").select(
        is_slot(F.col("ts"), "*/7 * * * *").alias("slot"),
        instance_at(F.col("ts"), nominal_literal("2015-06-10T00:00"), "*/7 * * * *").alias("instance")).collect()
    assert [r.slot for r in rows] == [True, True, True, False]
    assert [r.instance for r in rows] == [
        at("2015-06-10T00:56"), at("2015-06-10T00:56"), at("2015-06-10T01:03"), at("2015-06-09T23:53")]


def test_literal_schedule_is_folded(spark):
    df = times(spark, [at("2015-06-10T00:56")]).select(next_fire(F.col("ts"), "*/5 * * * *").alias("f"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and "RLIKE" not in plan
