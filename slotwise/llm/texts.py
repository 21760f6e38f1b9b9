"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Only A-Z change; `lower` would change other letters too."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part kept for testing; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of `df` by their names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def python_tasks(df: DataFrame) -> SparkContext:
    """The context of `df`, told where Python tasks find this package: at the driver's path, as far as they have it."""
    context = df.sparkSession.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return context


def chunks(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Parts of a batch, each of which ends with the text that brings it to so many characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def give_back() -> None:
    """Freed memory goes back to the system. Python workers serve one stage after another, and else keep it for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Rows through a function of column lists, one Arrow batch at a time; rows stay in the task that read them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            del batch, out
            give_back()

    python_tasks(df)
    return df.mapInArrow(run, schema)
