"""Schedules as data: the slots of a schedule, the slot of an event, the data instance of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.cron import (
    LAST_HOUR, LAST_MINUTE, Cron, cron_fields, drop_cron_fields, next_fire, plain_step, slot_of, stride_minutes,
    with_cron_fields,
)
from slotwise.functions.timeparts import minute_of_day, start_of_day


def fire_slots(schedules: DataFrame, cron: str = "cron", start: str = "start_at", end: str = "end_at") -> DataFrame:
    """One row per schedule and nominal time: ``schedules`` with a column ``nominal_time`` added.

    The first slot is the next one after ``start`` (see :func:`next_fire`); ``end`` is not included. All fields
    must match; ``*/n`` days count from the first of the month. A schedule that is not valid has no slots.
    """
    spread = [f.name for f in schedules.schema if not isinstance(f.dataType, T.MapType)]
    schedules, f = with_cron_fields(schedules, cron)
    days = (
        schedules
        .withColumn("_first", next_fire(F.col(start), f))
        # The condition is inside the generator: a filter would be pushed down and work out "_first" again.
        .withColumn("_day", F.explode(F.when(
            F.col("_first") < F.col(end), F.sequence(F.to_date("_first"), F.to_date(end)))))
        .where((F.dayofmonth("_day") - 1) % f.day_step == 0)
        # A few long schedules in one file must not stay in one task: spread their days, by every column, for
        # many schedules may be alike.
        .repartition(*spread, "_day")
    )
    # The slots of a day are numbered, and each number is taken apart into its hour and minute.
    minutes, hours = (_per(f.minute_step, LAST_MINUTE), _per(f.hour_step, LAST_HOUR))
    number = F.col("_number")
    hour = F.floor(number / minutes).cast("int") * F.coalesce(f.hour_step, F.lit(0)) + F.coalesce(f.hour_at, F.lit(0))
    minute = (number % minutes) * F.coalesce(f.minute_step, F.lit(0)) + F.coalesce(f.minute_at, F.lit(0))
    slots = (
        days
        .withColumn("_number", F.explode(F.sequence(F.lit(0), minutes * hours - 1)))
        .withColumn("nominal_time", start_of_day(F.col("_day")) + F.make_dt_interval(mins=hour * 60 + minute))
        # Only the first and the last day can have slots outside the bounds.
        .where((F.col("_day") > F.to_date("_first")) | (F.col("nominal_time") >= F.col("_first")))
        .where((F.col("_day") < F.to_date(end)) | (F.col("nominal_time") < F.col(end)))
    )
    return drop_cron_fields(slots).drop("_first", "_day", "_number")


def _per(step: Column, last: int) -> Column:
    """How many values a field takes: 0, n, 2n ... up to ``last``, or the one it is fixed to."""
    return F.coalesce((F.lit(last) - F.lit(last) % step) / step + 1, F.lit(1)).cast("int")


def is_slot(ts: Column, cron: Cron) -> Column:
    """Whether ``ts`` is a nominal time of the schedule, all fields looked at."""
    f = cron_fields(cron)

    def hit(value: Column, step, at=None) -> Column:
        if f.fixed:
            return value % step == 0 if step is not None else value == at
        tests = [value % step == 0] if at is None else [value % step == 0, value == at]
        return F.coalesce(*tests, F.lit(False))

    on_minute = ts == start_of_day(ts) + F.make_dt_interval(mins=minute_of_day(ts))
    return (on_minute & hit(F.minute(ts), f.minute_step, f.minute_at) & hit(F.hour(ts), f.hour_step, f.hour_at)
            & hit(F.dayofmonth(ts) - 1, f.day_step))


def slot_column(ts: str, cron: str) -> Column:
    """The slot of an event as a column to group by: a time window where all slots have one width."""
    step = plain_step(cron)
    return slot_of(F.col(ts), cron) if step is None else F.window(ts, step[0], startTime=step[1])["start"]


def events_per_slot(events: DataFrame, cron: str, ts: str = "ts") -> DataFrame:
    """Events counted by the slot they fall into; slots without events have no row."""
    return (events.groupBy(slot_column(ts, cron).alias("nominal_time"))
            .agg(F.count(F.lit(1)).alias("event_count")))


def slots_with_data(events: DataFrame, cron: str, ts: str = "ts") -> DataFrame:
    """The slots in which at least one event falls; a hot slot leaves each task as one row."""
    return events.select(slot_column(ts, cron).alias("nominal_time")).distinct()


def instance_at(nominal: Column, initial: Column, cron: str | Column) -> Column:
    """The data instance a run at ``nominal`` sees: the latest at or before it on a fixed stride from ``initial``.

    ``initial`` is a slot, so a whole minute. A stride of seven minutes runs on across the hour, where the slots
    of ``*/7`` start again at minute 0.
    """
    past = F.pmod(_epoch_minute(nominal) - _epoch_minute(initial), stride_minutes(cron))
    return start_of_day(nominal) + F.make_dt_interval(mins=(minute_of_day(nominal) - past).cast("int"))


def _epoch_minute(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("long") * 1440 + minute_of_day(ts)
