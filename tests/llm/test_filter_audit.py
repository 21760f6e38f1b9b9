"""Filter interaction audit against counting row by row, and its diagrams against their masks."""

from __future__ import annotations

import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from slotwise.llm.filter_audit import Diagram, audit, audit_part, marked_failures, swaps_through_all_orders, text_failures
from slotwise.llm.oracles import ORACLES
from slotwise.llm.queries import op13_filter_diagrams
from tests.llm.helpers import clashing, empty_documents, odd_documents
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), []
    for k in [None, *swaps_through_all_orders(n)]:
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def counted(masks, order):
    """Kept and removed by each filter of an order, mask by mask."""
    left, out = dict(masks), []
    for f in order:
        gone = {m: w for m, w in left.items() if m >> f & 1}
        left = {m: w for m, w in left.items() if not m >> f & 1}
        out.append((f, tuple(map(sum, zip((0, 0), *left.values()))), tuple(map(sum, zip((0, 0), *gone.values())))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_diagram_holds_its_masks_in_every_order(seed):
    draw = random.Random(seed)
    masks = {m: (draw.randrange(4), draw.randrange(3)) for m in draw.sample(range(16), draw.randrange(16))}
    diagram = Diagram(masks, 4, 2)
    assert diagram.steps() == counted(masks, range(4))
    for k in swaps_through_all_orders(4):
        diagram.swap(k)
        assert diagram.steps() == counted(masks, diagram.order)
        fresh = Diagram({sum(1 << i for i, f in enumerate(diagram.order) if m >> f & 1): w for m, w in masks.items()}, 4, 2)
        assert list(map(len, diagram.levels)) == list(map(len, fresh.levels))


def test_shares_of_all_orders():
    masks = {0b11: (5,), 0b01: (2,), 0: (3,)}
    rows = audit_part(masks, "XY", [])
    assert rows.to_dict("records") == [
        {"filter_order": "XY", "step": 1, "kept": 3, "removed": 7, "redundant": 0, "unique_fails": 2, "shapley": 9},
        {"filter_order": "XY", "step": 2, "kept": 3, "removed": 0, "redundant": 5, "unique_fails": 0, "shapley": 5},
        {"filter_order": "YX", "step": 1, "kept": 5, "removed": 5, "redundant": 0, "unique_fails": 0, "shapley": 5},
        {"filter_order": "YX", "step": 2, "kept": 3, "removed": 2, "redundant": 5, "unique_fails": 2, "shapley": 9},
    ]


def test_conditions_of_texts(spark):
    texts = {
        "few": "one two", "many": " ".join(f"w{i}" for i in range(200)), "same": "a\tb\n" * 150, "none": "", "blank": " \n ",
        "capitals": "A" * 4 + "b" * 96, "edge": "A" * 3 + "b" * 97, "sign": "a | b", "wide": "É" * 100,
    }
    rows = spark.createDataFrame([*texts.items()], "name string, text string")
    found = rows.select("name", *(c.alias(k) for k, c in text_failures(F.col("text")).items())).collect()
    assert {r.name: "".join(k for k in "ABCD" if r[k]) for r in found} == {
        "few": "A", "many": "", "same": "B", "none": "A", "blank": "A", "capitals": "AC", "edge": "A", "sign": "AD",
        "wide": "A"}


LABELS = "doc_id bigint, quality int, toxic int"


def by_hand(docs, labels):
    """Repeats of smaller ids, row by row."""
    return sorted(
        (r.doc_id is None, r.doc_id or 0, r.lang or "", any(
            o.doc_id is not None and r.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == (r.text or "")
            for o in docs),
         any(x[0] == r.doc_id and x[0] is not None and x[1] == 1 for x in labels),
         any(x[0] == r.doc_id and x[0] is not None and x[2] == 1 for x in labels))
        for r in docs)


def test_repeats_and_marks_row_by_row(spark):
    docs = clashing(odd_documents(spark), ["first", "place", "copies", "digest", "a.b"])
    extra = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    labels = [(0, 1, 0), (0, 0, 1), (1, None, 1), (2, 1, None), (103, 1, 1), (None, 1, 1)]
    found = marked_failures(docs, spark.createDataFrame(labels, LABELS)).collect()
    given = sorted((r.doc_id is None, r.doc_id or 0, r.part, r.E, bool(r.good), bool(r.toxic))
                   for r in found for _ in range(r.copies))
    assert given == by_hand(docs.collect(), labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = marked_failures(empty_documents(spark), labels)
    assert audit(rows, {"A": F.col("A")}, F.col("part")).collect() == []
    rows = marked_failures(odd_documents(spark), labels)
    found = audit(rows, {"A": F.col("A"), "E": F.col("E")}, F.lit(None), {"good": F.col("good")}, F.col("copies")).collect()
    assert {(r.part, r.filter_order, r.step) for r in found} == {("", o, s) for o in ("AE", "EA") for s in (1, 2)}
    assert {r.good_lost for r in found} == {0}


def test_filters_are_single_letters(spark):
    for filters in ({}, {"AB": F.lit(True)}, {c: F.lit(True) for c in "ABCDEFGH"}):
        with pytest.raises(ValueError):
            audit(spark.range(1), filters, F.lit("x"))


def test_query_on_odd_tables(spark, tmp_path):
    docs = odd_documents(spark)
    docs.unionByName(docs.limit(6).withColumn("doc_id", F.col("doc_id") + 50)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(60)] + [(3, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert spark_rows(op13_filter_diagrams(spark, str(tmp_path))) == sql_rows(con, ORACLES["op13_filter_diagrams"])
