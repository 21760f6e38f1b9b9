"""Schedules of the form ``minute hour day * *`` as column expressions.

A field is a number, ``*`` or ``*/n``; month and weekday must be ``*``. A schedule is given as text, as a column
of texts, or as :class:`CronFields` read once from such a column, so a table of schedules needs no loop.

Which slots a schedule has:

* minute ``*`` or ``*/n``: the minutes of the hour divisible by n; hour and day are not looked at
* minute fixed, hour ``*`` or ``*/n``: that minute of the hours of the day divisible by n; the day is not looked at
* minute and hour fixed: once a day
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.timeparts import minute_of_day, start_of_day

# What a field may look like, and its largest value.
NUMBER = r"^[0-9]+$"
STEP = r"^\*/[0-9]+$"
LAST_MINUTE, LAST_HOUR = 59, 23
LARGEST_STEP = 2**31 - 1


class CronFields(NamedTuple):
    """Fields of a schedule: n for ``*/n`` (1 for ``*``) in a step, a number in an ``at``, the other one empty.

    Numbers for a schedule given as text, integer columns for a column of schedules. No day number: a schedule
    on a fixed day is not valid.
    """

    minute_step: int | Column | None
    minute_at: int | Column | None
    hour_step: int | Column | None
    hour_at: int | Column | None
    day_step: int | Column | None

    @property
    def fixed(self) -> bool:
        return not any(isinstance(field, Column) for field in self)


Cron = str | Column | CronFields


def parse_cron(cron: str) -> CronFields:
    """The fields of one schedule; a ValueError if it is not valid."""
    fields = cron.rstrip(" ").split(" ")
    if len(fields) != 5 or fields[3:] != ["*", "*"]:
        raise ValueError(f"not a supported schedule: {cron!r}")

    def step(field: str) -> int | None:
        n = 1 if field == "*" else int(field[2:]) if re.match(STEP, field) else None
        return 0 if n is not None and n > LARGEST_STEP else n

    def at(field: str) -> int | None:
        return int(field) if re.match(NUMBER, field) else None

    minute, hour, day = fields[:3]
    parsed = CronFields(step(minute), at(minute), step(hour), at(hour), step(day))
    if (0 in (parsed.minute_step, parsed.hour_step, parsed.day_step) or parsed.day_step is None
            or (parsed.minute_step is None and (parsed.minute_at is None or parsed.minute_at > LAST_MINUTE))
            or (parsed.hour_step is None and (parsed.hour_at is None or parsed.hour_at > LAST_HOUR))):
        raise ValueError(f"not a supported schedule: {cron!r}")
    return parsed


def cron_texts(cron: Column) -> Column:
    """The texts of a schedule's fields as an array."""
    return F.split(F.rtrim(cron), " ")


def step_of(field: Column) -> Column:
    """n of ``*/n``, 1 for ``*``, NULL for anything else and for a step of zero."""
    n = F.substring_index(field, "/", -1).try_cast("int")
    return F.when(field == "*", 1).when(field.rlike(STEP), F.nullif(n, F.lit(0)))


def number_of(field: Column, last: int) -> Column:
    """The value of a fixed field, NULL for anything else and above ``last``."""
    n = field.try_cast("int")
    return F.when(field.rlike(NUMBER) & (n <= last), n)


def cron_fields(cron: Cron) -> CronFields:
    if isinstance(cron, CronFields):
        return cron
    if isinstance(cron, str):
        return parse_cron(cron)
    texts = cron_texts(cron)
    return _only_valid(texts, read_fields(texts))


def read_fields(texts: Column) -> CronFields:
    """The fields one by one, each NULL where its text is not what it should be."""
    minute, hour, day = (F.get(texts, i) for i in range(3))
    return CronFields(step_of(minute), number_of(minute, LAST_MINUTE), step_of(hour), number_of(hour, LAST_HOUR),
                      step_of(day))


def _only_valid(texts: Column, f: CronFields) -> CronFields:
    """All fields NULL unless the whole schedule is valid."""
    valid = (
        (F.size(texts) == 5) & (F.get(texts, 3) == "*") & (F.get(texts, 4) == "*")
        & F.coalesce(f.minute_step, f.minute_at).isNotNull()
        & F.coalesce(f.hour_step, f.hour_at).isNotNull()
        & f.day_step.isNotNull()
    )
    return CronFields(*(F.when(valid, field) for field in f))


def with_cron_fields(df: DataFrame, cron: str = "cron") -> tuple[DataFrame, CronFields]:
    """``df`` with the fields of its schedules as columns, so that each schedule text is read once per row."""
    names = [f"_{name}" for name in CronFields._fields]
    fields = CronFields(*map(F.col, names))
    df = df.withColumn("_texts", cron_texts(F.col(cron)))
    df = df.withColumns(dict(zip(names, read_fields(F.col("_texts")))))
    df = df.withColumns(dict(zip(names, _only_valid(F.col("_texts"), fields))))
    return df.drop("_texts"), fields


def drop_cron_fields(df: DataFrame) -> DataFrame:
    return df.drop(*(f"_{name}" for name in CronFields._fields))


def _column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _choose(f: CronFields, by_minute, by_hour, by_day) -> Column:
    """The one formula a fixed schedule needs, or a choice per row."""
    if f.fixed:
        chosen = by_minute if f.minute_step is not None else by_hour if f.hour_step is not None else by_day
        return chosen()
    return (F.when(f.minute_step.isNotNull(), by_minute())
            .when(f.hour_step.isNotNull(), by_hour())
            .otherwise(by_day()))


def next_fire(ts: Column, cron: Cron, inclusive: bool = False) -> Column:
    """The next slot after ``ts``; NULL for a schedule in a column that is not valid.

    Schedules with a fixed minute give the first slot at or after ``ts``. Those with minute ``*`` or ``*/n``
    give the first slot after the minute of ``ts``, so an exact boundary moves on; ``inclusive`` lets them
    stay on it too.
    """
    f = cron_fields(cron)
    hour, minute, now = F.hour(ts), F.minute(ts), minute_of_day(ts)
    day = start_of_day(ts)

    def past_minute() -> Column:
        return ts > day + F.make_dt_interval(mins=now)

    def by_minute() -> Column:
        after = hour * 60 + F.least(minute - minute % f.minute_step + f.minute_step, F.lit(60))
        if not inclusive:
            return after
        return F.when(~past_minute() & (minute % f.minute_step == 0), now).otherwise(after)

    def by_hour() -> Column:
        missed = (minute > f.minute_at) | ((minute == f.minute_at) & past_minute())
        first = hour + F.when(missed, 1).otherwise(0)
        # Hours count from midnight: past the last multiple of the day comes midnight.
        up = (_column(f.hour_step) - first % f.hour_step) % f.hour_step
        return F.least(first + F.least(up, F.lit(24)), F.lit(24)) * 60 + f.minute_at

    def by_day() -> Column:
        once = _column(f.hour_at) * 60 + f.minute_at
        missed = (now > once) | ((now == once) & past_minute())
        return once + F.when(missed, 1440).otherwise(0)

    return day + F.make_dt_interval(mins=_choose(f, by_minute, by_hour, by_day))


def slot_of(ts: Column, cron: Cron) -> Column:
    """The latest slot at or before ``ts``: the slot an event falls into."""
    f = cron_fields(cron)
    hour, minute, now = F.hour(ts), F.minute(ts), minute_of_day(ts)

    def by_minute() -> Column:
        return now - minute % f.minute_step

    def by_hour() -> Column:
        last = hour - F.when(minute < f.minute_at, 1).otherwise(0)
        # Before the first slot of the day: the last one of the day before.
        day_before = F.lit(LAST_HOUR - 24) - F.lit(LAST_HOUR) % f.hour_step
        return F.when(last < 0, day_before).otherwise(last - last % f.hour_step) * 60 + f.minute_at

    def by_day() -> Column:
        once = _column(f.hour_at) * 60 + f.minute_at
        return once - F.when(now < once, 1440).otherwise(0)

    return start_of_day(ts) + F.make_dt_interval(mins=_choose(f, by_minute, by_hour, by_day))


def plain_step(cron: str) -> tuple[str, str] | None:
    """Width and offset of the time window that is the slot of ``cron``; None if its slots differ in width."""
    f = parse_cron(cron)
    if f.minute_step is not None:
        return (f"{f.minute_step} minutes", "0 minutes") if 60 % f.minute_step == 0 else None
    if f.hour_step is not None:
        return (f"{f.hour_step} hours", f"{f.minute_at} minutes") if 24 % f.hour_step == 0 else None
    return "1 day", f"{f.hour_at * 60 + f.minute_at} minutes"


def stride(cron: str | Column) -> Column:
    """Fixed distance between the data instances of a schedule: struct of ``every`` and ``unit``.

    The first field from the left that is not a number decides; a daily schedule with ``*/n`` days has n days.
    """
    if isinstance(cron, str):
        parse_cron(cron)
        cron = F.lit(cron)
    return _stride(cron_fields(cron))


def _stride(f: CronFields) -> Column:
    return F.struct(
        F.coalesce(f.minute_step, f.hour_step, f.day_step).alias("every"),
        F.when(f.minute_step.isNotNull(), "minutes").when(f.hour_step.isNotNull(), "hours")
        .when(f.day_step.isNotNull(), "days").alias("unit"))


def stride_minutes(cron: str | Column) -> Column:
    s = stride(cron)
    factor = F.when(s["unit"] == "days", 1440).when(s["unit"] == "hours", 60).otherwise(1)
    return s["every"].cast("long") * factor


def audit_schedules(df: DataFrame, cron: str = "cron") -> DataFrame:
    """Add ``valid``, ``reason`` (NULL when valid), ``every`` and ``unit`` to a table of schedules."""
    names = [f"_text_{i}" for i in range(5)]
    df = df.withColumn("_texts", cron_texts(F.col(cron)))
    df = df.withColumns({name: F.get("_texts", i) for i, name in enumerate(names)})
    df = df.withColumns({f"_{name}": value for name, value in read_fields(F.array(*names))._asdict().items()})
    f = CronFields(*(F.col(f"_{name}") for name in CronFields._fields))
    minute, hour, day, month, weekday = map(F.col, names)

    def malformed(text: Column, step: Column) -> Column:
        return step.isNull() & ~text.rlike(STEP) & ~text.rlike(NUMBER)

    def zero_or_huge(text: Column, step: Column) -> Column:
        return step.isNull() & F.startswith(text, F.lit("*"))

    reason = (
        F.when(F.col(cron).isNull() | (F.size("_texts") != 5), "needs five fields")
        .when(malformed(minute, f.minute_step), "minute is not a number, * or */n")
        .when(malformed(hour, f.hour_step), "hour is not a number, * or */n")
        .when(malformed(day, f.day_step), "day is not a number, * or */n")
        .when((month != "*") | (weekday != "*"), "month and weekday must be *")
        .when(zero_or_huge(minute, f.minute_step) | zero_or_huge(hour, f.hour_step) | zero_or_huge(day, f.day_step),
              f"step must be from 1 to {LARGEST_STEP}")
        .when(f.minute_step.isNull() & f.minute_at.isNull(), "minute is above 59")
        .when(f.hour_step.isNull() & f.hour_at.isNull(), "hour is above 23")
        .when(f.day_step.isNull(), "day must be * or */n")
    )
    s = _stride(f)
    audited = df.withColumn("reason", reason).withColumns({
        "valid": F.col("reason").isNull(),
        "every": F.when(F.col("reason").isNull(), s["every"]),
        "unit": F.when(F.col("reason").isNull(), s["unit"]),
    })
    return drop_cron_fields(audited).drop("_texts", *names)
