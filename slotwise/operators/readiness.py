"""Ready marks of views, and the reports made from them: ready, missing and pending slots."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.sinks import cluster_by_slot, overwrite_slots
from slotwise.schemas import MARKER
from slotwise.session import delete_path, list_folders, path_exists
from slotwise.sources.datasets import View, as_view, text_literal

SLOT = "nominal_time"
MARKER_PARTS = ("view", "run_id")


def mark_ready(slots: DataFrame, view_name: str, markers: View | str) -> None:
    """Mark every slot of ``slots`` ready for a view; call it after the slots' data has been written."""
    mark_views(slots.select(F.lit(view_name).alias("view"), SLOT), markers)


def mark_views(marks: DataFrame, markers: View | str) -> None:
    """Add marks given as rows of view and nominal time; below each view, every run has a folder of its own.

    So runs that end at the same time do not meet. A slot marked twice counts once: readers take distinct slots.
    """
    marks = marks.select("view", SLOT, F.localtimestamp().alias("signalled_at"), F.lit(uuid.uuid4().hex).alias("run_id"))
    overwrite_slots(cluster_by_slot(marks, MARKER_PARTS), markers, MARKER_PARTS)


def ready_marks(spark: SparkSession, markers: View | str, view_name: str) -> DataFrame:
    """The slots marked for a view; none before the first mark."""
    return marks_of(spark, markers, [view_name]).select(SLOT)


def marks_of(spark: SparkSession, markers: View | str, view_names: Iterable[str]) -> DataFrame:
    """``view`` and slot of the marks of some views, each once; only their folders are listed, in one read."""
    return _marks(spark, as_view(markers), view_names).select("view", SLOT).distinct()


def _marks(spark: SparkSession, markers: View, view_names: Iterable[str]) -> DataFrame:
    names = sorted(set(view_names))
    if markers.parsed.table is not None:
        marks = spark.table(markers.parsed.table) if spark.catalog.tableExists(markers.parsed.table) else None
    else:
        root = markers.parsed.location
        folders = [f for f in (_marks_folder(spark, markers, name) for name in names) if path_exists(spark, f)]
        marks = spark.read.schema(MARKER).option("basePath", root).parquet(*folders) if folders else None
    if marks is None:
        return spark.createDataFrame([], MARKER)
    return marks.where(F.col("view").isin(names))


def _marks_folder(spark: SparkSession, markers: View, view_name: str) -> str:
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(view_name)
    return f"{markers.parsed.location}/view={escaped}"


def compact_marks(spark: SparkSession, markers: View | str, view_names: Iterable[str]) -> None:
    """One folder of marks per view in place of one per run; each slot keeps its first mark.

    The new folder is committed before the old ones go. Readers take distinct slots, so they see the same marks
    before, between and after, and marks added meanwhile stay.
    """
    markers = as_view(markers)
    if markers.parsed.table is not None:
        raise ValueError("marks in a catalog table are compacted by the catalog's own means")
    names = sorted(set(view_names))
    old = {name: list_folders(spark, _marks_folder(spark, markers, name)) for name in names}
    runs = [folder.rpartition("run_id=")[2] for folders in old.values() for folder in folders]
    if not runs:
        return
    known = spark.createDataFrame([(run,) for run in sorted(set(runs))], "run_id string")
    marks = _marks(spark, markers, names).join(known, "run_id", "left_semi")
    first = marks.groupBy("view", SLOT).agg(F.min("signalled_at").alias("signalled_at"))
    compacted = first.select("view", SLOT, "signalled_at", F.lit(uuid.uuid4().hex).alias("run_id"))
    overwrite_slots(cluster_by_slot(compacted, MARKER_PARTS), markers, MARKER_PARTS)
    for folders in old.values():
        for folder in folders:
            delete_path(spark, folder)


def withdraw_marks(slots: DataFrame, view_names: Iterable[str], markers: View | str) -> None:
    """Take the marks of some slots back, of all the views given; other slots keep theirs, with the time they were set.

    Only runs of marks that hold one of the slots are written anew: those that stay are committed first, and then the
    old folders go, so readers may for a moment see a mark twice but never miss one that stays.
    """
    spark, markers = slots.sparkSession, as_view(markers)
    marks = _marks(spark, markers, view_names)
    hit = marks.join(slots.select(SLOT), SLOT, "left_semi").groupBy("view", "run_id").agg(F.count("*").alias("n")).collect()
    if not hit:
        return
    known = spark.createDataFrame([(row.view, row.run_id) for row in hit], "view string, run_id string")
    kept = marks.join(known, ["view", "run_id"], "left_semi").join(slots.select(SLOT), SLOT, "left_anti")
    kept = kept.select("view", SLOT, "signalled_at", F.lit(uuid.uuid4().hex).alias("run_id"))
    overwrite_slots(cluster_by_slot(kept, MARKER_PARTS), markers, MARKER_PARTS)
    for row in hit:
        if markers.parsed.table is None:
            delete_path(spark, f"{_marks_folder(spark, markers, row.view)}/run_id={row.run_id}")
        else:
            names = f"`view` = {text_literal(row.view)}, `run_id` = {text_literal(row.run_id)}"
            spark.sql(f"ALTER TABLE {markers.parsed.table} DROP IF EXISTS PARTITION ({names})")


def ready_slots(slots: DataFrame, ready_by_input: Mapping[str, DataFrame],
                instances: Mapping[str, Column] | None = None) -> DataFrame:
    """The slots that every input has ready.

    An input with slots of its own is looked up at its instance for the slot (see :func:`instance_at`), given
    as a column over ``slots``.
    """
    for name, ready in ready_by_input.items():
        instance = (instances or {}).get(name, F.col(SLOT))
        slots = (slots.withColumn("_instance", instance)
                 .join(ready.select(F.col(SLOT).alias("_instance")), "_instance", "left_semi")
                 .drop("_instance"))
    return slots


def missing_slots(slots: DataFrame, ready: DataFrame) -> DataFrame:
    """The slots an input does not have."""
    return slots.join(ready.select(SLOT), SLOT, "left_anti")


def due_slots(slots: DataFrame, marks: DataFrame, inputs: Iterable[tuple[str, Column]],
              outputs: Iterable[str]) -> DataFrame:
    """:func:`pending_slots` over one table of marks (:func:`marks_of`): views of inputs with the instance that a slot
    needs of them, and views of outputs. One join with the marks, whatever the number of views."""
    def wanted(view: str, at: Column, is_input: bool) -> Column:
        return F.struct(F.lit(view).alias("view"), at.alias("_at"), F.lit(is_input).alias("_input"))

    needs = F.array(*(wanted(view, at, True) for view, at in inputs),
                    *(wanted(view, F.col(SLOT), False) for view in outputs))
    needed = slots.select(SLOT, F.explode(needs).alias("_need")).select(SLOT, "_need.*")
    marked = marks.select("view", F.col(SLOT).alias("_at"), F.lit(1).alias("_marked"))
    found = needed.join(marked, ["view", "_at"], "left").groupBy(SLOT).agg(
        F.count_if(F.col("_input") & F.col("_marked").isNull()).alias("_waits"),
        F.count_if(~F.col("_input") & F.col("_marked").isNull()).alias("_lacks"))
    return found.where("_waits = 0 and _lacks > 0").select(SLOT)


def pending_slots(slots: DataFrame, ready_by_input: Mapping[str, DataFrame], done_by_output: Mapping[str, DataFrame],
                  instances: Mapping[str, Column] | None = None) -> DataFrame:
    """The slots a triggered job must run for now: inputs ready, and at least one output not marked."""
    slots = ready_slots(slots, ready_by_input, instances)
    done = list(done_by_output.values())
    if len(done) == 1:
        return missing_slots(slots, done[0])
    return missing_slots(slots, ready_slots(slots, done_by_output))
