"""Runs with several outputs: one evaluation for all of them, and a journal from which a broken run is finished.

A run's outputs are written once, side by side, to a folder of the run; each is then placed in its dataset from there.
Until all of them are staged nothing that readers see has changed. From then on the run's folder says what is left to
do, so a run that breaks while it places its outputs is finished by the next one of its job, or by
:func:`finish_runs`, without computing anything again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.session import delete_path, list_folders, path_exists, shared_dir, touch
from slotwise.sources.datasets import View

OUTPUT = "output"

# Runs that this process is busy with; others of their job must not take them for broken.
_BUSY: set[str] = set()


@dataclass(frozen=True)
class Emitted:
    """Outputs that come from the same rows: for each its columns, and the condition of the rows that go there."""

    rows: DataFrame
    outputs: Mapping[str, tuple[tuple[Column, ...], Column | None]]

    def frame(self, name: str) -> DataFrame:
        """One output by itself."""
        columns, where = self.outputs[name]
        return (self.rows if where is None else self.rows.where(where)).select(*columns)


def emit(rows: DataFrame, **outputs: Column | tuple[list, Column | None] | None) -> Emitted:
    """What a job returns whose outputs all come from the same rows; these are then gone over once.

    Each output is given by the condition of its rows (None: all), or by its columns and the condition.
    """
    def one(given) -> tuple[tuple[Column, ...], Column | None]:
        columns, where = given if isinstance(given, tuple) else (["*"], given)
        names = rows.columns if columns == ["*"] else columns
        return tuple(F.col(_quoted(c)) if isinstance(c, str) else c for c in names), where

    return Emitted(rows, {name: one(given) for name, given in outputs.items()})


def tagged(results: Mapping[str, DataFrame] | Emitted) -> DataFrame:
    """All outputs as one table: ``output``, and a struct column of each output's fields, NULL in the others' rows.

    Rows of :class:`Emitted` outputs are read once; other outputs are put one below the other.
    """
    if isinstance(results, Emitted):
        names = list(results.outputs)
        kinds = {name: results.rows.select(*columns).schema for name, (columns, _) in results.outputs.items()}

        def row(name: str) -> Column:
            columns, where = results.outputs[name]
            record = F.struct(F.lit(name).alias(OUTPUT), *(
                (F.struct(*columns) if n == name else F.lit(None)).cast(kinds[n]).alias(_field(i)) for i, n in enumerate(names)))
            return record if where is None else F.when(where, record)

        every = F.filter(F.array(*map(row, names)), lambda r: r.isNotNull())
        return results.rows.select(F.explode(every).alias("_row")).select("_row.*")
    kinds = {name: df.schema for name, df in results.items()}
    parts = [
        df.select(F.lit(name).alias(OUTPUT), *(
            (F.struct(*(F.col(_quoted(c)) for c in df.columns)) if n == name else F.lit(None)).cast(kinds[n]).alias(_field(i))
            for i, n in enumerate(kinds)))
        for name, df in results.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_tagged(results: Mapping[str, DataFrame] | Emitted, path: str) -> T.StructType:
    """:func:`tagged` in a folder for each output; the schema to read it with."""
    rows = tagged(results)
    rows.write.mode("overwrite").partitionBy(OUTPUT).parquet(path)
    return rows.schema


def read_tagged(spark: SparkSession, path: str, schema: T.StructType, names: list[str]) -> dict[str, DataFrame]:
    """The outputs of :func:`write_tagged`; of each only its own folder and columns are read."""
    rows = spark.read.schema(schema).parquet(path)
    return {name: rows.where(F.col(OUTPUT) == name).select(f"{_field(i)}.*") for i, name in enumerate(names)}


def _field(i: int) -> str:
    return f"_o{i}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Run:
    """A run's folder: its slots, its outputs, what is to be done with them, and how far that has come."""

    spark: SparkSession
    path: str

    def note(self, **facts) -> None:
        text = json.dumps(facts)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/facts")
        touch(self.spark, f"{self.path}/staged")

    @property
    def staged(self) -> bool:
        return path_exists(self.spark, f"{self.path}/staged")

    def facts(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/facts", wholetext=True).first()[0])

    def done(self, step: str) -> bool:
        return path_exists(self.spark, f"{self.path}/done-{step}")

    def do(self, step: str, work: Callable[[], None]) -> None:
        """Do a step unless it is done; steps can be done again, so it does not matter where one broke off."""
        if not self.done(step):
            work()
            touch(self.spark, f"{self.path}/done-{step}")


def runs_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/slotwise/runs/{job}"


@contextmanager
def new_run(spark: SparkSession, job: str) -> Iterator[Run]:
    """A run's folder, there for the time of the run: it stays behind if the run breaks once its outputs are staged."""
    run = Run(spark, f"{runs_folder(spark, job)}/{uuid.uuid4().hex}")
    _BUSY.add(run.path)
    try:
        yield run
        delete_path(spark, run.path)
    except BaseException:
        if not run.staged:
            delete_path(spark, run.path)
        raise
    finally:
        _BUSY.discard(run.path)


def broken_runs(spark: SparkSession, job: str) -> list[Run]:
    """Runs of a job that this process is not busy with."""
    found = [Run(spark, path) for path in list_folders(spark, runs_folder(spark, job))]
    return [run for run in found if not any(run.path.endswith(busy.rpartition("/")[2]) for busy in _BUSY)]


def view_facts(view: View) -> dict:
    return {"uri": view.uri, "schema": None if view.schema is None else view.schema.json(), "parts": list(view.parts),
            "options": dict(view.options or {})}


def view_from(facts: dict) -> View:
    schema = None if facts["schema"] is None else T.StructType.fromJson(json.loads(facts["schema"]))
    return View(facts["uri"], schema, tuple(facts["parts"]), facts["options"] or None)
