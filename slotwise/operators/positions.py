"""Positions of rows in a global order, and the comparison of two tables row by row in their orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.session import shared_dir

# monotonically_increasing_id holds the task above these bits and the row's place in it below them.
PLACE_BITS = 33


def with_positions(df: DataFrame, order: Sequence[str | Column], into: str = "position") -> DataFrame:
    """``df`` with gapless positions from 0 in the order given; rows that tie in all of it follow in any order.

    No task sees more than a share: rows are dealt out by ranges, sorted and numbered within each, and the sizes of
    the ranges before it are added, one number per range. Rows are told apart in the order itself, so a third of
    them may tie. The sorted rows are checkpointed, for ranges that were drawn anew could have other sizes.
    """
    row, at = _free(df, "_row"), _free(df, "_at")
    keys = [*order, F.col(row)]
    shared_dir(df.sparkSession)
    ranged = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn(at, F.monotonically_increasing_id()).drop(row).checkpoint()
    part = F.shiftright(at, PLACE_BITS)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    start = F.get(F.lit(starts).cast("array<bigint>"), part.cast("int")) if starts else F.lit(0).cast("bigint")
    return placed.withColumn(into, start + F.col(at).bitwiseAND((1 << PLACE_BITS) - 1)).drop(at)


def reconcile_in_order(expected: DataFrame, actual: DataFrame, order: Sequence[str],
                       actual_order: Sequence[str] | None = None) -> DataFrame:
    """Positions at which two tables differ, each in its own order, with the row of either side as a struct.

    The columns of ``expected`` that do not order it are compared; where one side has no more rows it is NULL. Swapped
    rows show as two positions, a row too many as all positions after it.
    """
    columns = [c for c in expected.columns if c not in order]
    sides = []
    for name, df, by in (("expected", expected, order), ("actual", actual, actual_order or order)):
        record = F.struct(*(F.col(_quoted(c)) for c in columns)).alias(name)
        sides.append(with_positions(df.select(record, *(F.col(_quoted(c)).alias(f"_by{i}") for i, c in enumerate(by))),
                                    [f"_by{i}" for i in range(len(by))]).select("position", name))
    both = sides[0].join(sides[1], "position", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
