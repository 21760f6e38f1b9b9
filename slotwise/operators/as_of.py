"""Totals of a whole dataset as of many nominal times at once: what a report that runs slot by slot would have said."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.timeparts import minute_of_day, start_of_day
from slotwise.operators.positions import with_positions
from slotwise.operators.readiness import SLOT

MINUTES = 24 * 60
# Slots whose running totals one row of the plan holds for a key.
BLOCK = 1024


def running_totals(rows: DataFrame, slots: DataFrame, keys: Sequence[str], at: str | Column,
                   measures: Mapping[str, Column] | None = None, inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """For each slot and each key seen before it: the sums of ``measures`` over all rows from before it, and the slot.

    Without measures rows are counted as ``event_count``. A row counts from the first slot after its time ``at`` on,
    with ``inclusive`` from a slot at that very time; rows without a time count nowhere. Slots are whole minutes, as
    those of schedules are. A NULL key is a key, NULLs of a measure add nothing.

    No slot is joined with the rows before it. Rows become sums per key and first slot, merged in the tasks that read
    them; slots are numbered and cut into blocks. Of each key the sums of a block are added up within the block, and
    to these the totals of its earlier blocks, so a key with any number of rows and slots is dealt out by blocks. What
    comes out is one row per slot and key, as many as the reports themselves would hold.
    """
    sums = dict(measures or {"event_count": F.lit(1).cast("bigint")})
    numbered = with_positions(slots.select(SLOT).where(F.col(SLOT).isNotNull()).distinct(), [SLOT], "_number")
    entered = _first_slots(rows.withColumn("_at", F.col(at) if isinstance(at, str) else at), numbered, inclusive)
    partial = entered.groupBy(*keys, "_number").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    return _through_slots(partial, numbered, list(keys), list(sums), block)


def _first_slots(rows: DataFrame, numbered: DataFrame, inclusive: bool) -> DataFrame:
    """Rows with the number of the first slot that sees them; rows after the last slot are left out.

    A slot's number is how many slots come before it. For each day there is an array over its minutes: how many slots
    lie before each, so a row finds its slot by an equal day and its minute. The calendar is as long as the slots reach.
    """
    first, last = numbered.agg(F.min(SLOT), F.max(SLOT)).first()
    first, last = (F.lit(None if t is None else t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (first, last))
    every_day = numbered.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("_day"))
    on_day = numbered.groupBy(F.to_date(SLOT).alias("_day")).agg(
        F.sort_array(F.collect_list(minute_of_day(F.col(SLOT)))).alias("_minutes"), F.min("_number").alias("_before"))
    # Days without slots lie before the same slots as the next day with some. A calendar is short enough for one task.
    ahead = Window.orderBy("_day").rowsBetween(0, Window.unboundedFollowing)
    known = every_day.join(on_day, "_day", "left").withColumns({
        "_before": F.min("_before").over(ahead), "_minutes": F.coalesce("_minutes", F.array().cast("array<int>"))})
    until = F.array_append("_minutes", F.lit(MINUTES))
    lengths = F.transform(until, lambda minute, i: F.array_repeat(
        F.col("_before") + i, minute - F.when(i > 0, F.get("_minutes", i - 1)).otherwise(F.lit(-1))))
    days = known.select("_day", F.flatten(lengths).alias("_slots_before"))

    at = F.col("_at").cast("timestamp_ntz")
    minute = minute_of_day(at)
    if inclusive:
        on_minute = at == start_of_day(at) + F.make_dt_interval(mins=minute)
        minute = minute + F.when(on_minute, 0).otherwise(1)
    else:
        minute = minute + 1
    seen = rows.where(at <= last if inclusive else at < last).withColumns({"_day": F.to_date(at), "_minute": minute})
    number = F.when(F.col("_day") < F.to_date(first), F.lit(0).cast("bigint")).otherwise(F.get("_slots_before", "_minute"))
    return seen.join(days, "_day", "left").withColumn("_number", number)


def _through_slots(partial: DataFrame, numbered: DataFrame, keys: list[str], names: list[str], block: int) -> DataFrame:
    """Sums per key and first slot, added up from slot to slot."""
    def block_of(number: str) -> Column:
        return F.floor(F.col(number) / block).cast("int")

    place = F.pmod(F.col("_number"), F.lit(block)).cast("int")
    inside = Window.partitionBy(*keys, "_block").orderBy("_number")
    running = partial.withColumn("_block", block_of("_number")).select(
        *keys, "_block", F.struct(place.alias("place"), *(F.sum(n).over(inside).alias(n) for n in names)).alias("_entry"))
    # No more entries than a block has slots.
    blocks = running.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_entry")).alias("_entries"))
    total = F.element_at("_entries", -1)
    in_turn = Window.partitionBy(*keys).orderBy("_block")
    earlier = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    times = numbered.groupBy(block_of("_number").alias("_here")).agg(F.sort_array(F.collect_list(SLOT)).alias("_times"))
    blocks = blocks.withColumns({
        **{f"_carried_{n}": F.coalesce(F.sum(total[n]).over(earlier), F.lit(0)) for n in names},
        "_next": F.lead("_block").over(in_turn), "_first": F.row_number().over(in_turn) == 1})
    # A key's block, and the blocks after it in which nothing new comes up.
    last = times.agg(F.max("_here")).first()[0]
    until = F.coalesce(F.col("_next"), F.lit(0 if last is None else last + 1)) - 1
    held = blocks.withColumn("_here", F.explode(F.sequence("_block", until)))
    own = F.col("_here") == F.col("_block")
    none = F.slice("_entries", 1, 0)
    held = held.withColumns({
        **{f"_carried_{n}": F.col(f"_carried_{n}") + F.when(own, F.lit(0)).otherwise(total[n]) for n in names},
        "_entries": F.when(own, F.col("_entries")).otherwise(none),
        "_first": F.col("_first") & own})
    held = held.join(times, "_here")
    size = F.size("_times")
    start = F.when(F.size("_entries") > 0, F.get("_entries", F.lit(0))["place"]).otherwise(size)
    kept = F.transform("_entries", lambda e, i: F.array_repeat(
        e, F.coalesce(F.get("_entries", i + 1)["place"], size) - e["place"]))
    # Before its first entry a key that came up in an earlier block keeps what it had; a new one has no rows.
    before = F.when(F.col("_first"), none).otherwise(F.array_repeat(F.lit(None).cast(_entry_type(held)), start))
    line = F.arrays_zip(F.slice("_times", F.when(F.col("_first"), start + 1).otherwise(F.lit(1)), size).alias("time"),
                        F.concat(before, F.flatten(kept)).alias("entry"))
    rows = held.select(*keys, *(f"_carried_{n}" for n in names), F.explode(line).alias("_row"))
    return rows.select(*keys, *((F.col(f"_carried_{n}") + F.coalesce(F.col(f"_row.entry.{n}"), F.lit(0))).alias(n) for n in names),
                       F.col("_row.time").alias(SLOT))


def _entry_type(held: DataFrame):
    return held.schema["_entries"].dataType.elementType
