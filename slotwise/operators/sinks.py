"""Writing views: one slot, many slots, or one batch of a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.timeparts import parts_upto, with_time_parts
from slotwise.session import delete_path
from slotwise.sources.datasets import SAFE_VALUE, View, as_view, is_number, plain_value, text_literal


def write_view(df: DataFrame, view: View | str) -> None:
    """Replace the slot a view names by ``df``; without constraints, append to the dataset.

    The slot's values come from the view, so columns of that name in ``df`` are dropped. A slot written again,
    also with nothing, loses its old rows, once the new ones are committed: a run that fails leaves it as it was.
    No shuffle: a slot of any size is written by the tasks that made it.
    """
    view = as_view(view).known(df.sparkSession)
    slot = view.constraints
    if not slot:
        append(df, view)
        return
    order = slot_order(view)
    written = Observation()
    rows = df.drop(*slot).withColumns({part: view.slot_value(part) for part in order})
    overwrite_slots(rows.observe(written, F.count(F.lit(1)).alias("rows")), view, order)
    if not written.get["rows"]:
        drop_slot(df.sparkSession, view)


def slot_order(view: View) -> tuple[str, ...]:
    """Partition columns of the slot a view names, outermost first."""
    order = view.parts or tuple(view.constraints)
    if set(order) != set(view.constraints):
        raise ValueError(f"{view.uri} must give exactly the partition columns {', '.join(order)}")
    for part in order:
        if not re.fullmatch(SAFE_VALUE, view.constraints[part]):
            raise ValueError(f"{part}={view.constraints[part]} cannot name a slot")
    return order


def slot_folder(view: View) -> str:
    """Folder of the slot a path view names: constraints outermost first, numbers unpadded."""
    named = (f"{part}={plain_value(view.constraints[part], view.type_of(part))}" for part in slot_order(view))
    return "/".join([view.parsed.location, *named])


def drop_slot(spark: SparkSession, view: View) -> None:
    """Remove the slot a view names, if it is there."""
    if view.parsed.table is None:
        delete_path(spark, slot_folder(view))
    else:
        spark.sql(f"ALTER TABLE {view.parsed.table} DROP IF EXISTS {partition_spec(view)}")


def partition_spec(view: View) -> str:
    """``PARTITION (...)`` of the slot a catalog view names."""
    def text(part: str, value: str) -> str:
        plain = plain_value(value, view.type_of(part))
        return plain if is_number(value, view.type_of(part)) else text_literal(plain)

    return "PARTITION (" + ", ".join(f"`{part}` = {text(part, value)}" for part, value in view.constraints.items()) + ")"


def append(df: DataFrame, view: View | str, parts: Sequence[str] = ()) -> None:
    view = as_view(view)
    if view.parsed.table is not None:
        df.select(*df.sparkSession.table(view.parsed.table).columns).write.mode("append").insertInto(view.parsed.table)
    else:
        df.write.mode("append").partitionBy(*parts).parquet(view.parsed.location)


def overwrite_slots(df: DataFrame, view: View | str, parts: Sequence[str]) -> None:
    """Replace every slot that ``df`` has rows for, in one job; other slots stay."""
    view = as_view(view)
    if view.parsed.table is None:
        overwrite_folders(df, view.parsed.location, parts)
        return
    spark = df.sparkSession
    rows = df.select(*spark.table(view.parsed.table).columns)
    # A catalog table takes the mode from the session only, and a static overwrite would empty all other slots.
    with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        rows.write.insertInto(view.parsed.table, overwrite=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of one write; it is left alone if it is so already."""
    before = spark.conf.get(key)
    if before.lower() == value:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def overwrite_folders(df: DataFrame, root: str, parts: Sequence[str]) -> None:
    """:func:`overwrite_slots` below a folder. Rows become visible when the job commits; writers of different
    slots do not get in each other's way."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(root))


def cluster_by_slot(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Bring the rows of a slot together so a slot gets few files.

    A rebalance, not a plain repartition: adaptive execution splits a slot that is larger than the target size
    over several tasks and packs small slots into one, so a hot hour does not land on one executor.
    """
    return df.hint("rebalance", *parts)


def write_time_partitioned(df: DataFrame, view: View | str, ts: str, upto: str = "minute",
                           mode: str = "append", clustered: bool = False) -> None:
    """Write partitioned by the calendar parts of an event time.

    ``mode`` is ``append``, or ``overwrite`` to replace the slots that occur in ``df``. Pass ``clustered=True``
    for data that already lies slot by slot, and the shuffle is left out.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode {mode!r} is neither append nor overwrite")
    parts = parts_upto(upto)
    rows = with_time_parts(df, ts, upto)
    if not clustered:
        rows = cluster_by_slot(rows, parts)
    if mode == "append":
        append(rows, view, parts)
    else:
        overwrite_slots(rows, view, parts)


def save_nonempty(df: DataFrame, view: View | str) -> bool:
    """Append ``df`` to a view unless it has no rows; tells whether rows were written.

    A partitioned dataset gets no folder from an empty write, so ``df`` is run once and its rows are counted on
    the way. For one without partitions a first row is looked for, and ``df`` is run again from there.
    """
    view = as_view(view)
    slot = {part: view.slot_value(part) for part in view.constraints}
    parts = view.parts or list(slot)
    if not parts:
        if df.isEmpty():
            return False
        append(df, view)
        return True
    written = Observation()
    rows = df.drop(*slot).withColumns(slot).observe(written, F.count(F.lit(1)).alias("rows"))
    append(rows, view, parts)
    return written.get["rows"] > 0
