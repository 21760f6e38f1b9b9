"""Record transforms of jobs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators.sinks import write_view
from slotwise.sources.datasets import View, as_view, read_view


def odd_users(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows with ``user % 2 = 1``; a negative odd id has remainder -1 and is dropped."""
    return df.where(F.col(user) % 2 == 1)


def keys(df: DataFrame, *by: str) -> DataFrame:
    """The key of every record, duplicates kept."""
    return df.select(*by)


def count_by_key(df: DataFrame, *by: str) -> DataFrame:
    """Rows per key. Counted on the map side first, so a hot key sends one row per task."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def union_inputs(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all inputs, matched by column name, duplicates kept."""
    if not inputs:
        raise ValueError("a union needs at least one input")
    return reduce(DataFrame.unionByName, inputs.values())


def copy_view(spark, source: View | str, target: View | str) -> None:
    """Copy the rows of one view into another; slot values are those of the target."""
    source, target = as_view(source), as_view(target)
    write_view(read_view(spark, source).drop(*source.constraints), target)


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: ``side`` missing or unexpected, and by how many ``copies``.

    One pass over both inputs and one aggregation, in which copies of a hot row merge before the shuffle.
    """
    columns = expected.columns
    signed = (expected.withColumn("_copies", F.lit(1).cast("long"))
              .unionByName(actual.select(*columns).withColumn("_copies", F.lit(-1).cast("long"))))
    difference = signed.groupBy(*columns).agg(F.sum("_copies").alias("_copies")).where(F.col("_copies") != 0)
    return difference.select(
        *columns,
        F.when(F.col("_copies") > 0, "missing").otherwise("unexpected").alias("side"),
        F.abs("_copies").alias("copies"),
    )
