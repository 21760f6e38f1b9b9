"""Filter interaction audit: what each filter removes in every order of the filters, by weighted decision diagrams.

Filters are failure conditions of rows. Rows are counted on Spark by part and failure mask (which filters a row fails),
with map-side combination, so a part is a table of at most 2**n masks however many rows it has. One diagram per part
holds it: a level per filter, a node with a branch for passing and one for failing, equal nodes made one, and the counts
of what lies below at each node. Exchanging two neighbouring levels gives the next order; a chain of such swaps visits
all n! orders, and the path that passes everything, read from the root, is an order's steps: what goes on along the
pass branches is kept, what leaves by the fail branch is removed.

Null parts count as the empty part. Null texts count as empty ones. A null id is never a repeat and never makes one;
rows with equal id and text count one by one and do not make each other repeats. Marks without a row in the table of
labels are not set; an id labelled twice has a mark if one of its rows has. An empty table has no parts and no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import UPPER, free_name, python_tasks

#: n! orders of n filters are reported.
MOST_FILTERS = 7
#: Rows without an id are dealt to so many places where others are dealt by their id.
SPREAD = 1024

Weights = tuple[int, ...]


class Diagram:
    """A decision diagram over failure bits; the weights below a node are those of all masks that lead through it."""

    def __init__(self, masks: Mapping[int, Weights], n: int, size: int):
        """`masks` maps a mask, whose bit i is set if filter i fails, to weights, vectors of `size` numbers."""
        none = (0,) * size
        self.order = list(range(n))
        found: dict[Weights, int] = {}
        below = []
        for path in range(1 << n):
            mask = sum(1 << i for i in range(n) if path >> (n - 1 - i) & 1)
            below.append(found.setdefault(masks.get(mask, none), len(found)))
        #: Of each level its nodes: the two nodes of the next level that a pass and a failure lead to.
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.totals: list[list[Weights]] = [[] for _ in range(n)] + [list(found)]
        for k in reversed(range(n)):
            nodes: dict[tuple[int, int], int] = {}
            below = [nodes.setdefault((below[i], below[i + 1]), len(nodes)) for i in range(0, len(below), 2)]
            self._set_level(k, list(nodes))

    def _set_level(self, k: int, nodes: list[tuple[int, int]]) -> None:
        below = self.totals[k + 1]
        self.levels[k] = nodes
        self.totals[k] = [tuple(map(sum, zip(below[p], below[f]))) for p, f in nodes]

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1. Nodes above keep their meaning, so nothing else changes."""
        lower = self.levels[k + 1]
        nodes: dict[tuple[int, int], int] = {}
        upper = []
        for p, f in self.levels[k]:
            passed = nodes.setdefault((lower[p][0], lower[f][0]), len(nodes))
            failed = nodes.setdefault((lower[p][1], lower[f][1]), len(nodes))
            upper.append((passed, failed))
        self._set_level(k + 1, list(nodes))
        self._set_level(k, upper)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[int, Weights, Weights]]:
        """Along the path that passes all: filter, weights kept after it, weights removed by it."""
        node, out = 0, []
        for k, filter_ in enumerate(self.order):
            passed, failed = self.levels[k][node]
            out.append((filter_, self.totals[k + 1][passed], self.totals[k + 1][failed]))
            node = passed
        return out


def swaps_through_all_orders(n: int) -> Iterator[int]:
    """Places k at which to exchange k and k + 1, n! - 1 of them, so that every order comes up once."""
    if n < 2:
        return
    inner = swaps_through_all_orders(n - 1)
    for turn in range(factorial(n - 1)):
        # The last filter runs down through the others, or up again; then the others go on by one swap.
        down = turn % 2 == 0
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is not None:
            yield step + (1 if down else 0)


def audit_part(masks: Mapping[int, Weights], filters: Sequence[str], marks: Sequence[str]) -> pd.DataFrame:
    """The steps of all orders of one part, from its masks' weights: rows, then rows of each mark."""
    n = len(filters)
    diagram = Diagram(masks, n, 1 + len(marks))
    orders = [diagram.steps()]
    for k in swaps_through_all_orders(n):
        diagram.swap(k)
        orders.append(diagram.steps())
    failing, alone, total = {}, {}, dict.fromkeys(range(n), 0)
    for steps in orders:
        failing[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for filter_, _, removed in steps:
            total[filter_] += removed[0]
    rows = []
    for steps in orders:
        order = "".join(filters[f] for f, _, _ in steps)
        for k, (f, kept, removed) in enumerate(steps, 1):
            rows.append((order, k, kept[0], removed[0], failing[f] - removed[0], alone[f], *removed[1:], total[f]))
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]
    return pd.DataFrame(rows, columns=names)


def mask_of(fails: Sequence[Column]) -> Column:
    """The bits of the conditions that hold; an unknown one does not."""
    bits = [F.when(fail, F.lit(1 << i)).otherwise(F.lit(0)) for i, fail in enumerate(fails)]
    return sum(bits[1:], bits[0])


def audit(rows: DataFrame, filters: Mapping[str, Column], part: Column, marks: Mapping[str, Column] | None = None,
          copies: Column | None = None) -> DataFrame:
    """part and the steps of every order of `filters` (a letter for each, and the condition of failing it) over `rows`.

    `marks` are conditions; of each, the rows it holds for are counted as `<mark>_lost` where they are removed. `copies`
    is how many rows a row stands for, one if it is not given.
    """
    if not 0 < len(filters) <= MOST_FILTERS or any(len(letter) != 1 for letter in filters):
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited, each named by one letter")
    marks, letters = marks or {}, "".join(filters)
    copies = F.lit(1) if copies is None else copies
    counted = rows.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"),
                           mask_of([*filters.values()]).alias("mask")).agg(
        F.sum(copies).cast("bigint").alias("rows"),
        *(F.coalesce(F.sum(F.when(mark, copies)), F.lit(0)).cast("bigint").alias(f"m{i}")
          for i, mark in enumerate(marks.values())))
    names = [*marks]
    kinds = "step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint"
    lost = "".join(f", `{m}_lost` bigint" for m in names)

    def of_part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        weights = zip(group["rows"].tolist(), *(group[f"m{i}"].tolist() for i in range(len(names))))
        out = audit_part(dict(zip(group["mask"].tolist(), weights)), letters, names)
        out.insert(0, "part", key[0])
        return out

    python_tasks(rows)
    return counted.groupBy("part").applyInPandas(of_part, f"part string, filter_order string, {kinds}{lost}, shapley bigint")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions of a text alone, by letter: few words, few different ones, many capitals, markup signs."""
    words = F.array_remove(F.split(text, "[ \t-\r]+"), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def marked_failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """`part`, failures A to E, marks `good` and `toxic` and `copies` of documents, one row per id, text and part.

    E is a text that a smaller id has too. Texts go by their SHA-256, so what is shuffled is small: rows that are alike
    merge first; the smallest id of each text is found by a count that merges in the tasks, and brought back by text and
    id, so a text that a third of all rows have is spread by their ids.
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(text)
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        *(fail.alias(letter) for letter, fail in fails.items()))
    rows = rows.groupBy("doc_id", "digest", "part", *fails).agg(F.count("*").alias("copies"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    firsts = firsts.withColumn("first", F.lit(True))
    marked = labels.groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("place", F.lit(0))
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    found = rows.join(firsts, ["doc_id", "digest"], "left").withColumn("place", place).join(marked, ["doc_id", "place"], "left")
    return found.withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
