"""Calendar parts of a nominal time, templates filled from them, and the printed form of a nominal time."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.schemas import TIME_PARTS

# The holes of a view template and the part each one takes.
HOLES = {
    "${YEAR}": "year",
    "${MONTH}": "month",
    "${DAY}": "day",
    "${HOUR}": "hour",
    "${MINUTE}": "minute",
}

# Fixed value: printed form of a nominal time, always UTC.
NOMINAL_FORMAT = "yyyy-MM-dd'T'HH:mm'Z'"


def parts_upto(upto: str) -> tuple[str, ...]:
    """The time columns down to ``upto``: ``"day"`` gives year, month, day."""
    if upto not in TIME_PARTS:
        raise ValueError(f"{upto!r} is not one of {', '.join(TIME_PARTS)}")
    return TIME_PARTS[: TIME_PARTS.index(upto) + 1]


def time_parts(ts: Column, upto: str = "minute") -> dict[str, Column]:
    """Year, month (1-12), day of month, hour (0-23) and minute as integer columns."""
    extract = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
    return {part: extract[part](ts) for part in parts_upto(upto)}


def with_time_parts(df: DataFrame, ts: str, upto: str = "minute") -> DataFrame:
    return df.withColumns(time_parts(F.col(ts), upto))


def slot_time(parts: Mapping[str, Column] | list[str] | tuple[str, ...]) -> Column:
    """The instant a set of time columns stands for; parts that are not given take their first value.

    Built from partition columns only, so a filter on it prunes folders.
    """
    given = dict(parts) if isinstance(parts, Mapping) else {part: F.col(part) for part in parts}
    first = {"month": F.lit(1), "day": F.lit(1), "hour": F.lit(0), "minute": F.lit(0)}
    year, month, day, hour, minute = ((given.get(part) if part in given else first[part]) for part in TIME_PARTS)
    return F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def start_of_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def render_template(template: str | Column, ts: Column, padded: bool = False) -> Column:
    """Fill the time holes of a view template, unpadded (``month=5``) or zero-padded (``month=05``)."""
    def text(part: str) -> Column:
        value = time_parts(ts)[part].cast("string")
        width = 4 if part == "year" else 2
        return F.lpad(value, width, "0") if padded else value

    if isinstance(template, str):
        pieces = re.split("(" + "|".join(map(re.escape, HOLES)) + ")", template)
        return F.concat(*(text(HOLES[p]) if p in HOLES else F.lit(p) for p in pieces if p))
    for hole, part in HOLES.items():
        template = F.replace(template, F.lit(hole), text(part))
    return template


def fill_template(template: str, nominal_time: dt.datetime) -> str:
    """:func:`render_template` for one nominal time."""
    for hole, part in HOLES.items():
        template = template.replace(hole, str(getattr(nominal_time, part)))
    return template


def format_nominal(ts: Column) -> Column:
    return F.date_format(ts, NOMINAL_FORMAT)


def parse_nominal(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(NOMINAL_FORMAT))


def as_nominal(value: str | dt.datetime) -> dt.datetime:
    """A nominal time given as text or as a datetime; aware datetimes are taken to UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def nominal_literal(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal; a plain datetime literal would depend on the machine's zone."""
    return F.lit(as_nominal(value).isoformat(sep=" ")).cast("timestamp_ntz")


def to_millis(ts: Column) -> Column:
    """Epoch milliseconds of a UTC TIMESTAMP_NTZ, for payloads that carry time as a number."""
    seconds = F.unix_date(ts.cast("date")) * F.lit(86400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def from_millis(millis: Column) -> Column:
    return F.timestamp_add("MILLISECOND", millis, nominal_literal("1970-01-01T00:00"))
