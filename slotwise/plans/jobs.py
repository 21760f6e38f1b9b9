"""Jobs: plain functions from named input DataFrames to named output DataFrames, bound to views by a nominal time.

The same function serves one slot, many slots and streams. For tables, every input has a column ``nominal_time``
in place of the partition columns its view fills from the time; a job that aggregates groups by it and keeps it
in its outputs.
"""

from __future__ import annotations

import datetime as dt
import inspect
import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from dataclasses import field as dataclass_field
from itertools import islice
from urllib.parse import urlencode

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions.cron import next_fire, parse_cron, plain_step, slot_of
from slotwise.functions.timeparts import HOLES, as_nominal, nominal_literal, slot_time, time_parts
from slotwise.operators.readiness import SLOT, due_slots, mark_ready, marks_of, withdraw_marks
from slotwise.operators.sinks import cluster_by_slot, overwrite_slots, partition_spec, slot_folder, write_view
from slotwise.operators.slots import fire_slots, instance_at
from slotwise.plans.runs import (
    Emitted, Run, broken_runs, new_run, read_tagged, tagged, view_facts, view_from, write_tagged,
)
from slotwise.plans.settings import input_settings, job_settings, with_prefix
from slotwise.session import delete_path, shared_dir, work_path
from slotwise.sources.datasets import View, as_view, list_files, load, quoted_column, read_at
from slotwise.sources.topics import Topic, read_topic
from slotwise.streaming.closing import closing_sink
from slotwise.streaming.sinks import (
    BATCH_INTERVAL, dataset_sink, for_each_batch, stream_to_dataset, stream_to_topic, topic_sink,
)

SLOTS = T.StructType([T.StructField(SLOT, T.TimestampNTZType())])

# Fixed value: names of jobs.
JOB_NAME = r"[a-zA-Z][-_a-zA-Z0-9]*"

# A plan names up to this many runs of days to prune folders by; more are merged with their neighbours.
DAY_RUNS = 1000

# Partitions dropped by one statement, and folders deleted at a time.
DROP_BATCH = 500
DELETIONS = 16


@dataclass(frozen=True)
class Job:
    """A job function with the names, and optionally the record schemas, of its inputs and outputs.

    ``inputs=None`` makes it dynamic: it takes whatever inputs it is run with. A function may also ask for
    ``slots`` (the nominal times of the run, a DataFrame) and ``settings`` (the job's settings). It returns its outputs
    by name, or its only one, or :func:`emit` if they all come from the same rows.
    """

    name: str
    function: Callable[..., Mapping[str, DataFrame] | DataFrame | Emitted]
    inputs: Mapping[str, T.StructType | None] | None
    outputs: Mapping[str, T.StructType | None]

    def __post_init__(self) -> None:
        if not re.fullmatch(JOB_NAME, self.name):
            raise ValueError(f"job name {self.name!r} must match {JOB_NAME}")

    def check_names(self, inputs: Iterable[str], outputs: Iterable[str]) -> None:
        declared = [("output", self.outputs, set(outputs))]
        if self.inputs is not None:
            declared.append(("input", self.inputs, set(inputs)))
        for kind, wanted, given in declared:
            if given - set(wanted):
                raise ValueError(f"job {self.name} has no {kind} {', '.join(sorted(given - set(wanted)))}")
            if set(wanted) - given:
                raise ValueError(f"job {self.name} needs {kind} {', '.join(sorted(set(wanted) - given))}")

    def takes(self, extra: str) -> bool:
        """Whether the function asks for ``slots`` or ``settings``."""
        return extra in inspect.signature(self.function).parameters

    def results(self, inputs: Mapping[str, DataFrame], **extra) -> dict[str, DataFrame] | Emitted:
        """Outputs as the function returns them, each checked against its record schema."""
        for name, schema in (self.inputs or {}).items():
            check_record(inputs[name], schema, f"input {name} of job {self.name}")
        result = self.function(**inputs, **{k: v for k, v in extra.items() if self.takes(k)})
        if isinstance(result, DataFrame):
            (only,) = self.outputs
            result = {only: result}
        emitted = isinstance(result, Emitted)
        self.check_names(inputs, result.outputs if emitted else result)
        checked = {}
        for name, schema in self.outputs.items():
            what = f"output {name} of job {self.name}"
            check_record(result.frame(name) if emitted else result[name], schema, what)
            if emitted:
                columns, where = result.outputs[name]
                checked[name] = tuple(with_required(result.rows.select(*columns).schema, columns, schema, what)), where
            else:
                df = result[name]
                columns = [F.col(quoted_column(c)) for c in df.columns]
                demanded = with_required(df.schema, columns, schema, what)
                checked[name] = df if demanded is columns else df.select(*demanded)
        return Emitted(result.rows, checked) if emitted else checked

    def __call__(self, inputs: Mapping[str, DataFrame], **extra) -> dict[str, DataFrame]:
        results = self.results(inputs, **extra)
        return {name: results.frame(name) for name in self.outputs} if isinstance(results, Emitted) else results


def job(name: str, inputs: Mapping[str, T.StructType | None] | Iterable[str] | None,
        outputs: Mapping[str, T.StructType | None] | Iterable[str]) -> Callable[[Callable], Job]:
    """Declare a function as a job."""
    def declare(function: Callable) -> Job:
        return Job(name, function, None if inputs is None else _named(inputs), _named(outputs))
    return declare


def _named(parameters) -> dict[str, T.StructType | None]:
    return dict(parameters) if isinstance(parameters, Mapping) else dict.fromkeys(parameters)


def check_record(df: DataFrame, schema: T.StructType | None, what: str) -> None:
    """Refuse a DataFrame that lacks a declared field or has it with another type, nested ones included.

    What the types allow to be NULL is left to :func:`with_required`.
    """
    for field in schema or ():
        wanted = field.dataType.simpleString()
        given = df.schema[field.name].dataType.simpleString() if field.name in df.columns else "missing"
        if given != wanted:
            raise TypeError(f"{what}: {field.name} should be {wanted}, is {given}")


def with_required(given: T.StructType, columns: Sequence[Column], schema: T.StructType | None, what: str) -> Sequence[Column]:
    """``columns``, of the fields ``given``, that fail when they are computed for a row with a NULL where ``schema`` has none.

    The check is part of the plan that writes the rows: no pass of its own. It looks at fields, nested ones, elements
    of arrays and values of maps, stops at the first, and names it with the row. What Spark knows to be never NULL is
    not looked at. It is bound to a column that the schema declares, so leaving others out does not leave it out.
    """
    by_name = dict(zip(given.fieldNames(), columns, strict=True))
    offences = [o for field in schema or () for o in _offences(by_name[field.name], given[field.name], field, field.name)]
    if not offences:
        return columns
    first = F.coalesce(*(F.when(broken, F.lit(name)) for broken, name in offences))
    row = F.to_json(F.struct(*(by_name[field.name].alias(field.name) for field in schema)))
    held = schema[0].name
    failure = F.raise_error(F.concat(F.lit(f"{what}: "), first, F.lit(" is NULL in "), row))
    checked = F.when(first.isNull(), by_name[held]).otherwise(failure.cast(given[held].dataType)).alias(held)
    return [checked if name == held else column.alias(name) for name, column in by_name.items()]


def _offences(value: Column, given: T.StructField, wanted: T.StructField, name: str) -> list[tuple[Column, str]]:
    """Conditions under which a value breaks what its field demands, with the name of what is NULL then."""
    found = []
    if not wanted.nullable and given.nullable:
        found.append((value.isNull(), name))
    return found + _nested(value, given.dataType, wanted.dataType, name)


def _nested(value: Column, given: T.DataType, wanted: T.DataType, name: str) -> list[tuple[Column, str]]:
    """As :func:`_offences`, of what lies below a value; a NULL has nothing below it."""
    if isinstance(wanted, T.StructType):
        return [(value.isNotNull() & broken, below) for field in wanted for broken, below in _offences(
            value.getField(field.name), given[field.name], field, f"{name}.{field.name}")]
    if isinstance(wanted, T.ArrayType):
        element = T.StructField("element", wanted.elementType, wanted.containsNull)
        of = T.StructField("element", given.elementType, given.containsNull)
        return _each(value, of, element, f"{name}[]")
    if isinstance(wanted, T.MapType):
        element = T.StructField("value", wanted.valueType, wanted.valueContainsNull)
        of = T.StructField("value", given.valueType, given.valueContainsNull)
        return _each(F.map_values(value), of, element, f"{name}{{}}")
    return []


def _each(values: Column, given: T.StructField, wanted: T.StructField, name: str) -> list[tuple[Column, str]]:
    def any_breaks(i: int) -> Column:
        found = F.exists(values, lambda x: F.coalesce(_offences(x, given, wanted, name)[i][0], F.lit(False)))
        return F.coalesce(found, F.lit(False))

    return [(any_breaks(i), below) for i, (_, below) in enumerate(_offences(F.lit(None), given, wanted, name))]


# From the nominal time of a run to the time that fills the view of an input.
Instance = Callable[[Column], Column]


def run_at(spark: SparkSession, job: Job, nominal_time: str | dt.datetime, inputs: Mapping[str, View | str],
           outputs: Mapping[str, View | str], markers: View | str | None = None,
           settings: Mapping[str, str] | None = None, instances: Mapping[str, Instance] | None = None) -> None:
    """Run a job for one slot: read its views, replace the slot of each output, then mark the outputs ready.

    Outputs are marked even if they came out empty; a run that fails marks nothing. Marks that the slot has from an
    earlier run are withdrawn before its rows are touched. Views are filled from the nominal time, those of inputs in
    ``instances`` from the time these give for it. Several outputs are staged together, see :mod:`slotwise.plans.runs`.
    """
    job.check_names(inputs, outputs)
    outputs = {name: as_view(view) for name, view in outputs.items()}
    of_job = job_settings(settings or {}, job.name)
    now = nominal_literal(nominal_time)
    slots = spark.range(1).select(now.alias(SLOT))
    finish_runs(spark, job)
    frames = {}
    for name, view in inputs.items():
        view = as_view(view)
        at = nominal_time
        if name in (instances or {}):
            at = slots.select(instances[name](F.col(SLOT))).first()[0]
        view = _with_settings(view, input_settings(of_job, name))
        frames[name] = read_at(spark, view, at).drop(*view.slot_parts).withColumn(SLOT, now)
    results = job.results(frames, slots=slots, settings=of_job)
    if len(outputs) > 1:
        facts = {"at": as_nominal(nominal_time).isoformat()}
        _run_staged(spark, job, slots, results, outputs, markers, facts)
        return
    for name, rows in _frames(results).items():
        _withdraw(slots, outputs, markers)
        write_view(rows.drop(SLOT), outputs[name].at(nominal_time))
    _mark(slots, outputs, markers)


def backfill(spark: SparkSession, job: Job, slots: DataFrame, inputs: Mapping[str, View | str],
             outputs: Mapping[str, View | str], markers: View | str | None = None,
             settings: Mapping[str, str] | None = None, instances: Mapping[str, Instance] | None = None,
             clustered: bool = False) -> None:
    """Run a job for many slots at once: one plan, and one write per output, whatever the number of slots.

    Slots that are run again are replaced, also those that come out empty; their marks are withdrawn before. Several
    outputs are staged by one evaluation and placed from there, see :mod:`slotwise.plans.runs`. ``clustered=True``
    leaves out the shuffle before the write, for jobs that only filter or project data that lies slot by slot.

    An input without time holes is a whole dataset. It comes without nominal times, so the job has to ask for
    ``slots`` and say what each of them sees, as :func:`running_totals` does.
    """
    job.check_names(inputs, outputs)
    outputs = {name: as_view(view) for name, view in outputs.items()}
    for name, view in outputs.items():
        if not view.slot_parts:
            raise ValueError(f"output {name}: a backfill needs time holes in {view.uri}")
    of_job = job_settings(settings or {}, job.name)
    finish_runs(spark, job)
    # Pinned: slots may come from the markers this run adds to.
    work = work_path(spark, "slots")
    slots.select(SLOT).distinct().write.mode("overwrite").parquet(work)
    try:
        slots = spark.read.schema(SLOTS).parquet(work)
        bounds = Bounds.of(slots)
        if bounds is None:
            return
        frames = {
            name: _slot_rows(slots, bounds, name, _with_settings(as_view(view), input_settings(of_job, name)),
                             (instances or {}).get(name, _itself), job.takes("slots"))
            for name, view in inputs.items()
        }
        results = job.results(frames, slots=slots, settings=of_job)
        for name, rows in _frames(results).items():
            if SLOT not in rows.columns:
                raise ValueError(f"job {job.name}: output {name} must keep the column {SLOT}")
        if len(outputs) > 1:
            _run_staged(spark, job, slots, results, outputs, markers, {"clustered": clustered})
            return
        for name, rows in _frames(results).items():
            _withdraw(slots, outputs, markers)
            _replace_slots(spark, slots, bounds, rows, outputs[name], clustered)
        _mark(slots, outputs, markers)
    finally:
        delete_path(spark, work)


def _frames(results: Mapping[str, DataFrame] | Emitted) -> dict[str, DataFrame]:
    if isinstance(results, Emitted):
        return {name: results.frame(name) for name in results.outputs}
    return dict(results)


def _run_staged(spark: SparkSession, job: Job, slots: DataFrame, results: Mapping[str, DataFrame] | Emitted,
                outputs: Mapping[str, View], markers: View | str | None, facts: dict) -> None:
    """Stage all outputs by one write, note what is to be done with them, and do it."""
    names = list(_frames(results))
    with new_run(spark, job.name) as run:
        slots.select(SLOT).write.mode("overwrite").parquet(f"{run.path}/slots")
        schema = write_tagged(results, f"{run.path}/outputs")
        run.note(names=names, schema=schema.json(), outputs={n: view_facts(outputs[n]) for n in names},
                 markers=None if markers is None else view_facts(as_view(markers)), **facts)
        _finish(run)


def _finish(run: Run) -> None:
    """What a staged run has left to do: withdraw marks, place each output, mark."""
    spark, facts = run.spark, run.facts()
    slots = spark.read.schema(SLOTS).parquet(f"{run.path}/slots")
    outputs = {name: view_from(facts["outputs"][name]) for name in facts["names"]}
    markers = None if facts["markers"] is None else view_from(facts["markers"])
    staged = read_tagged(spark, f"{run.path}/outputs", T.StructType.fromJson(json.loads(facts["schema"])), facts["names"])
    run.do("withdraw", lambda: _withdraw(slots, outputs, markers))
    for number, (name, view) in enumerate(outputs.items()):
        def place(rows: DataFrame = staged[name], view: View = view) -> None:
            if "at" in facts:
                write_view(rows.drop(SLOT), view.at(facts["at"]))
            else:
                _replace_slots(spark, slots, Bounds.of(slots), rows, view, facts["clustered"])

        run.do(f"output-{number}", place)
    run.do("mark", lambda: _mark(slots, outputs, markers))


def finish_runs(spark: SparkSession, job: Job | str) -> int:
    """Finish the runs of a job that broke after their outputs were staged, undo those that broke before; how many.

    Every run of the job does so first. Call it before that if consumers should not wait for the next run. Runs of one
    job in several drivers at once need folders of their own in ``spark.checkpoint.dir``.
    """
    found = broken_runs(spark, job if isinstance(job, str) else job.name)
    for run in found:
        if run.staged:
            _finish(run)
        delete_path(spark, run.path)
    return len(found)


def _withdraw(slots: DataFrame, outputs: Mapping[str, View], markers: View | str | None) -> None:
    if markers is not None:
        withdraw_marks(slots, [view.known(slots.sparkSession).marks for view in outputs.values()], markers)


@dataclass(frozen=True)
class Bounds:
    """The first and the last of some slots, and the runs of days that they lie on."""

    first: dt.datetime
    last: dt.datetime
    days: tuple[tuple[dt.date, dt.date], ...]

    @staticmethod
    def of(slots: DataFrame, instance: Instance | None = None) -> Bounds | None:
        """None without slots. The driver sees a row per run of days, as many as there are gaps between days."""
        at = (instance or _itself)(F.col(SLOT))
        days = slots.select(at.alias("at")).groupBy(F.to_date("at").alias("day")).agg(
            F.min("at").alias("first"), F.max("at").alias("last"))
        # Days in a row share their distance to their rank; a calendar has few enough days for one task.
        rank = F.row_number().over(Window.orderBy("day"))
        runs = (days.withColumn("run", F.date_sub("day", rank)).groupBy("run")
                .agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min("first").alias("first"),
                     F.max("last").alias("last")).orderBy("a").collect())
        if not runs:
            return None
        return Bounds(runs[0].first, runs[-1].last, tuple(_merged([(r.a, r.b) for r in runs], DAY_RUNS)))


def _merged(runs: list[tuple[dt.date, dt.date]], most: int) -> list[tuple[dt.date, dt.date]]:
    """At most ``most`` runs that cover the given ones: those with the smallest gaps between them become one."""
    if len(runs) <= most:
        return runs
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
    kept = sorted(gaps[len(runs) - most:])
    starts, ends = [0, *kept], [*kept, len(runs)]
    return [(runs[a][0], runs[b - 1][1]) for a, b in zip(starts, ends, strict=True)]


def _itself(nominal_time: Column) -> Column:
    return nominal_time


def _slot_keys(slots: DataFrame, view: View, instance: Instance = _itself) -> DataFrame:
    """Each slot with the partition values that the view's holes take for it."""
    parts = time_parts(F.col("_instance"))
    keyed = slots.withColumn("_instance", instance(F.col(SLOT)))
    return keyed.select(SLOT, *(parts[part].alias(column) for column, part in view.slot_parts.items()))


def _within(spark: SparkSession, view: View, bounds: Bounds) -> DataFrame:
    """What a view's dataset holds on the days of some slots.

    The folder that all slots share is listed, and below it a filter that names partition columns only, so folders
    of other days are not read. The filter is part of the plan: it needs no broadcast, and has a bounded length.
    """
    rows = _fixed_part(load(spark, view.dataset(), _shared_folders(view, bounds)), view)
    return rows.where(_on_days(view, bounds))


def _shared_folders(view: View, bounds: Bounds) -> list[tuple[str, int]]:
    folders = []
    for column in view.parts:
        part = view.slot_parts.get(column)
        if part is None or getattr(bounds.first, part) != getattr(bounds.last, part):
            break
        folders.append((column, getattr(bounds.first, part)))
    return folders


def _on_days(view: View, bounds: Bounds) -> Column:
    column_of = {part: column for column, part in view.slot_parts.items()}
    if "year" not in column_of:
        return F.lit(True)
    at = slot_time({part: F.col(column) for part, column in column_of.items()})
    of_first = time_parts(nominal_literal(bounds.first))
    within = (F.col(column_of["year"]).between(bounds.first.year, bounds.last.year)
              & (at >= slot_time({part: of_first[part] for part in column_of}))
              & (at <= nominal_literal(bounds.last)))
    if len(bounds.days) > 1 and {"month", "day"} <= set(column_of):
        day = sum(F.col(column_of[part]).cast("int") * size for part, size in (("year", 10_000), ("month", 100), ("day", 1)))
        runs = [day.between(_day_number(a), _day_number(b)) for a, b in bounds.days]
        while len(runs) > 1:  # in pairs, so that the expression stays flat
            runs = [a | b for a, b in zip(runs[::2], runs[1::2])] + runs[len(runs) // 2 * 2:]
        within = within & runs[0]
    return within


def _day_number(day: dt.date) -> int:
    return day.year * 10_000 + day.month * 100 + day.day


def _slot_rows(slots: DataFrame, bounds: Bounds, name: str, view: View, instance: Instance = _itself,
               whole: bool = False) -> DataFrame:
    """The rows of an input for all slots, each with its nominal time; slots that share a folder share its rows.

    How the slots are joined is left to adaptive execution. With ``whole``, an input may be a whole dataset.
    """
    if not view.slot_parts and whole:
        return _fixed_part(load(slots.sparkSession, view.dataset()), view)
    if not view.slot_parts:
        raise ValueError(f"input {name}: a backfill needs time holes in {view.uri}, or a job that asks for slots")
    if instance is not _itself:
        bounds = Bounds.of(slots, instance)
    keys = _slot_keys(slots, view, instance)
    return _within(slots.sparkSession, view, bounds).join(keys, list(view.slot_parts)).drop(*view.slot_parts)


def _fixed_part(rows: DataFrame, view: View) -> DataFrame:
    for column, value in view.constraints.items():
        if value not in HOLES:
            rows = rows.where(F.col(column) == F.lit(value).cast(rows.schema[column].dataType))
    return rows


def _replace_slots(spark: SparkSession, slots: DataFrame, bounds: Bounds, rows: DataFrame, view: View,
                   clustered: bool) -> None:
    """Write the rows of all slots, and empty the slots that held rows before and got none.

    The job is run once, by the write. Which files the slots hold is noted before it; a slot that still holds one of
    them afterwards was not replaced, for files have names of their own. So what counts is what was committed.
    """
    view = view.known(spark)
    order = list(view.parts or view.constraints)
    parts = time_parts(F.col(SLOT))
    values = {
        column: parts[HOLES[value]] if value in HOLES else view.slot_value(column)
        for column, value in view.constraints.items()
    }
    rows = rows.withColumns(values).drop(SLOT)
    noted = work_path(spark, "held")
    try:
        held = _held_files(spark, slots, bounds, view, order)
        if held is not None:
            held.write.mode("overwrite").parquet(noted)
            held = spark.read.schema(held.schema).parquet(noted)
            if held.isEmpty():
                held = None
        overwrite_slots(rows if clustered else cluster_by_slot(rows, order), view, order)
        now = _held_files(spark, slots, bounds, view, order) if held is not None else None
        if now is not None:
            stale = now.join(held.select("path"), "path", "left_semi").select(*order).distinct()
            _drop_slots(spark, view, order, stale)
    finally:
        delete_path(spark, noted)


def _held_files(spark: SparkSession, slots: DataFrame, bounds: Bounds, view: View, order: list[str]) -> DataFrame | None:
    """``path`` and partition values of the files that the slots hold; None if there is no dataset yet.

    Of folders the names are listed; of a catalog table its partition columns are read with the files' names.
    """
    keys = _slot_keys(slots, view).select(*view.slot_parts)
    try:
        if view.parsed.table is None:
            files = list_files(spark, replace(view.dataset(), parts=tuple(order)), _shared_folders(view, bounds))
        else:
            files = load(spark, view.dataset()).select(F.col("_metadata.file_path").alias("path"), *order)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    files = _fixed_part(files, view).where(_on_days(view, bounds))
    return files.join(keys, list(view.slot_parts), "left_semi").select("path", *order).distinct()


def _drop_slots(spark: SparkSession, view: View, order: list[str], stale: DataFrame) -> None:
    """Remove slots, which come to the driver by name, a part at a time; an object store takes some at once."""
    base = view.dataset()

    def named(slot: Row) -> View:
        query = urlencode({part: slot[part] for part in order})
        return View(f"{base.uri}?{query}", view.schema, tuple(order))

    names = map(named, stale.toLocalIterator())
    with ThreadPoolExecutor(DELETIONS) as pool:
        while batch := list(islice(names, DROP_BATCH)):
            if view.parsed.table is None:
                list(pool.map(lambda slot: delete_path(spark, slot_folder(slot)), batch))
            else:
                specs = ", ".join(map(partition_spec, batch))
                spark.sql(f"ALTER TABLE {view.parsed.table} DROP IF EXISTS {specs}")


def _with_settings(view: View, settings: Mapping[str, str]) -> View:
    """The view with the ``hadoop.`` settings of its parameter as options of the reader."""
    return replace(view, options={**(view.options or {}), **with_prefix(settings, "hadoop.")})


def _mark(slots: DataFrame, outputs: Mapping[str, View], markers: View | str | None) -> None:
    if markers is not None:
        for view in outputs.values():
            mark_ready(slots, view.known(slots.sparkSession).marks, markers)


@dataclass(frozen=True)
class Schedule:
    """A job, its slots and its views.

    Inputs and outputs arrive with the job's slots. An input with slots of its own, in ``input_crons``, is taken
    at its latest instance at or before the nominal time. Instances keep a fixed stride, counted from the first
    slot after ``start_at``; without one, schedules whose slots have that stride anyway can be used.
    """

    job: Job
    cron: str
    outputs: Mapping[str, View]
    inputs: Mapping[str, View] = dataclass_field(default_factory=dict)
    input_crons: Mapping[str, str] = dataclass_field(default_factory=dict)
    start_at: str | dt.datetime | None = None

    def __post_init__(self) -> None:
        parse_cron(self.cron)
        self.job.check_names(self.inputs, self.outputs)
        if set(self.input_crons) - set(self.inputs):
            raise ValueError(f"no input {', '.join(sorted(set(self.input_crons) - set(self.inputs)))}")
        for name, cron in self.input_crons.items():
            fields = parse_cron(cron)
            # Slots of an event ignore the hour under a minute step, the slots of a schedule do not.
            uneven = plain_step(cron) is None or fields.day_step > 1 or (
                fields.minute_step is not None and (fields.hour_at is not None or (fields.hour_step or 1) > 1))
            if uneven and self.start_at is None:
                raise ValueError(f"input {name}: the stride of {cron!r} needs start_at")

    def instances(self) -> dict[str, Instance]:
        """For inputs with slots of their own, the instance that a run sees."""
        def of(cron: str) -> Instance:
            if self.start_at is None:
                return lambda nominal: slot_of(nominal, cron)
            return lambda nominal: instance_at(nominal, next_fire(nominal_literal(self.start_at), cron), cron)

        return {name: of(cron) for name, cron in self.input_crons.items()}

    def slots(self, spark: SparkSession, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
        """The nominal times from the next slot after ``start`` up to ``end``, ``end`` left out."""
        one = spark.range(1).select(
            F.lit(self.cron).alias("cron"),
            nominal_literal(start).alias("start_at"),
            nominal_literal(end).alias("end_at"))
        return fire_slots(one).select(SLOT)

    def due(self, spark: SparkSession, markers: View | str, start: str | dt.datetime,
            end: str | dt.datetime) -> DataFrame:
        """The slots to run now: every input has marked the instance the slot needs, an output lacks its mark."""
        instances = self.instances()
        inputs = [(view.known(spark).marks, instances.get(name, _itself)(F.col(SLOT))) for name, view in self.inputs.items()]
        outputs = sorted({view.known(spark).marks for view in self.outputs.values()})
        marks = marks_of(spark, markers, [*(name for name, _ in inputs), *outputs])
        return due_slots(self.slots(spark, start, end), marks, inputs, outputs)

    def run_at(self, spark: SparkSession, nominal_time: str | dt.datetime, **options) -> None:
        run_at(spark, self.job, nominal_time, self.inputs, self.outputs, instances=self.instances(), **options)

    def backfill(self, spark: SparkSession, slots: DataFrame, **options) -> None:
        backfill(spark, self.job, slots, self.inputs, self.outputs, instances=self.instances(), **options)


DUE = T.StructType([
    T.StructField("job", T.StringType()), T.StructField("wave", T.IntegerType()), T.StructField(SLOT, T.TimestampNTZType())])


def due_in_waves(spark: SparkSession, schedules: Iterable[Schedule], markers: View | str, start: str | dt.datetime,
                 end: str | dt.datetime) -> DataFrame:
    """``job``, ``wave`` and slots of what can run now, and of what can once that has run: the plan of chained schedules.

    Wave 1 waits for nothing but marks that are there; a slot of a later wave needs outputs of the wave before it. A
    slot whose inputs nobody marks or makes is not in the plan, one whose outputs are all marked has no need to be.
    Schedules are worked off by how long the chain before them is, all of one length together: one join with what is
    marked or planned so far, checkpointed. Chains that come back to themselves are refused.
    """
    schedules = list(schedules)
    names = [schedule.job.name for schedule in schedules]
    if len(set(names)) < len(names):
        raise ValueError("schedules of one plan need jobs of different names")
    needs, makes = {}, {}
    for schedule in schedules:
        instances = schedule.instances()
        needs[schedule.job.name] = [
            (view.known(spark).marks, instances.get(name, _itself)(F.col(SLOT))) for name, view in schedule.inputs.items()]
        makes[schedule.job.name] = sorted({view.known(spark).marks for view in schedule.outputs.values()})
    views = {name for given in needs.values() for name, _ in given} | {name for given in makes.values() for name in given}
    known = checkpointed_small(spark, marks_of(spark, markers, views).select("view", F.col(SLOT).alias("_at"), F.lit(0).alias("_wave")))
    due = spark.createDataFrame([], DUE)
    for level in _levels(needs, makes):
        wanted = None
        for schedule in schedules:
            job_name = schedule.job.name
            if job_name not in level:
                continue
            entries = [_need(view, at, True) for view, at in needs[job_name]] + [
                _need(view, F.col(SLOT), False) for view in makes[job_name]]
            rows = schedule.slots(spark, start, end).select(
                F.lit(job_name).alias("job"), SLOT, F.explode(F.array(*entries)).alias("_need")).select("job", SLOT, "_need.*")
            wanted = rows if wanted is None else wanted.unionByName(rows)
        found = wanted.join(known, ["view", "_at"], "left").groupBy("job", SLOT).agg(
            F.count_if(F.col("_input") & F.col("_wave").isNull()).alias("_waits"),
            F.count_if(~F.col("_input") & (F.coalesce("_wave", F.lit(1)) > 0)).alias("_lacks"),
            F.coalesce(F.max(F.when(F.col("_input"), F.col("_wave"))), F.lit(0)).alias("_after"))
        planned = checkpointed_small(spark, found.where("_waits = 0 and _lacks > 0").select(
            "job", (F.col("_after") + 1).cast("int").alias("wave"), SLOT))
        due = due.unionByName(planned)
        made = F.create_map(*(F.lit(x) for name in level for x in (name, makes[name])))
        new = planned.select(F.explode(made[F.col("job")]).alias("view"), F.col(SLOT).alias("_at"), F.col("wave").alias("_wave"))
        known = known.unionByName(new).groupBy("view", "_at").agg(F.min("_wave").alias("_wave"))
    return due


def _need(view: str, at: Column, is_input: bool) -> Column:
    return F.struct(F.lit(view).alias("view"), at.alias("_at"), F.lit(is_input).alias("_input"))


def _levels(needs: Mapping[str, list], makes: Mapping[str, list[str]]) -> list[set[str]]:
    """Jobs by the longest chain of jobs before them."""
    before = {job: {other for other in makes if set(makes[other]) & {view for view, _ in needs[job]}} for job in needs}
    levels, done = [], set()
    while len(done) < len(before):
        level = {job for job, others in before.items() if job not in done and others <= done}
        if not level:
            raise ValueError(f"jobs wait for each other: {', '.join(sorted(set(before) - done))}")
        levels.append(level)
        done |= level
    return levels


def checkpointed_small(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of slots, kept in the shared folder, so that plans of many waves stay short."""
    shared_dir(spark)
    return df.checkpoint()


def run_schedules(spark: SparkSession, schedules: Iterable[Schedule], nominal_time: str | dt.datetime,
                  **options) -> None:
    """Run every schedule of an application for one nominal time, in the order given."""
    for schedule in schedules:
        schedule.run_at(spark, as_nominal(nominal_time), **options)


def run_stream(spark: SparkSession, job: Job, inputs: Mapping[str, Topic], outputs: Mapping[str, Topic | View],
               checkpoint: str, available_now: bool = False, interval: str = BATCH_INTERVAL,
               settings: Mapping[str, str] | None = None,
               event_times: Mapping[str, str] | None = None, markers: View | str | None = None,
               lateness: str = "0 seconds") -> list[StreamingQuery]:
    """Start a job on streams: topics in, topics or datasets out; one query per output, each with a checkpoint.

    Outputs that the job gives by :func:`emit` share one query, which reads each message once. ``event_times`` names, for outputs partitioned by time, the column that the time is taken from. With
    ``markers`` the slots of these outputs are marked ready as they close, see :func:`closing_sink`.
    """
    job.check_names(inputs, outputs)
    closing = {} if markers is None else {"markers": markers, "lateness": lateness}
    for name, source in inputs.items():
        if not isinstance(source, Topic):
            raise TypeError(f"input {name} of job {job.name}: a streaming job reads topics only")
    frames = {name: read_topic(spark, topic, streaming=True) for name, topic in inputs.items()}
    results = job.results(frames, settings=job_settings(settings or {}, job.name))
    if isinstance(results, Emitted):
        return [_stream_emitted(spark, results, outputs, checkpoint, event_times or {}, available_now, interval, closing)]
    timing = {"available_now": available_now, "interval": interval}
    return [
        stream_to_topic(rows, outputs[name], f"{checkpoint}/{name}", **timing)
        if isinstance(outputs[name], Topic) else
        stream_to_dataset(rows, outputs[name], f"{checkpoint}/{name}", event_time=(event_times or {}).get(name), **timing, **closing)
        for name, rows in results.items()
    ]


def _stream_emitted(spark: SparkSession, results: Emitted, outputs: Mapping[str, Topic | View], checkpoint: str,
                    event_times: Mapping[str, str], available_now: bool, interval: str,
                    closing: Mapping[str, View | str]) -> StreamingQuery:
    """One query for all outputs: a batch is evaluated once, into a work folder, and placed from there.

    A batch that is replayed replaces its own files in every output.
    """
    names = list(results.outputs)
    rows = tagged(results)
    sinks = {}
    for name in names:
        sdf = results.frame(name)
        sinks[name] = (topic_sink if isinstance(outputs[name], Topic) else dataset_sink)(
            sdf, outputs[name], *([] if isinstance(outputs[name], Topic) else [event_times.get(name)]))
        if closing and name in event_times and not isinstance(outputs[name], Topic):
            sinks[name] = closing_sink(
                sinks[name], outputs[name], event_times[name], progress=f"{checkpoint}/reached/{name}", **closing)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        staged = work_path(session, "batch")
        try:
            batch.write.mode("overwrite").partitionBy("output").parquet(staged)
            for name, part in read_tagged(session, staged, rows.schema, names).items():
                sinks[name](part, batch_id)
        finally:
            delete_path(session, staged)

    return for_each_batch(rows, write_batch, checkpoint, available_now, interval)


def compact_stream(spark: SparkSession, slots: DataFrame, streamed: View, target: View, markers: View | str | None = None,
                   clustered: bool = False) -> None:
    """Closed slots of a dataset that a stream writes, as few files in a dataset of their own.

    A stream makes a folder per batch within each slot. Slots that get no more rows are read through these folders
    and written anew, replacing what an earlier compaction made of them; the streamed dataset is left as it is.
    """
    copy = Job("compact-stream", lambda streamed: streamed, {"streamed": None}, {"compacted": None})
    backfill(spark, copy, slots, {"streamed": streamed}, {"compacted": target}, markers, clustered=clustered)
