"""Older files under newer schemas."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.sources.datasets import View, ensure_dataset, read_dataset, read_view, refine
from slotwise.sources.evolution import check_update, field
from tests.test_datasets import database  # noqa: F401


def struct(*fields):
    return T.StructType(list(fields))


def written(rows, path):
    rows.write.mode("append").parquet(path)


def test_widths_defaults_and_fields_that_go(spark, folder):
    path = folder("d")
    written(spark.sql("select cast(1 as int) id, cast(0.5 as float) x, date'2024-02-03' at, 'old' gone"), path)
    written(spark.sql("select 5000000000 id, 0.1d x, timestamp_ntz'2024-02-03 04:05:06' at, cast(null as string) tag"), path)
    schema = struct(field("tag", "string", "'none'"), field("id", "long"), field("x", "double"), field("at", "timestamp_ntz"))
    rows = read_dataset(spark, View("dataset:" + path, schema)).select("id", "x", F.col("at").cast("string"), "tag")
    # A null that was written stays; only a file without the field has its default.
    assert sorted(tuple(r) for r in rows.collect()) == [
        (1, 0.5, "2024-02-03 00:00:00", "none"), (5000000000, 0.1, "2024-02-03 04:05:06", None)]


def test_defaults_at_any_depth(spark, folder):
    path = folder("d")
    written(spark.sql("select named_struct('a', 1, 'in', named_struct('b', 'x')) s, array(named_struct('b', 'y'), null) l, "
                      "map('k', named_struct('b', 'z')) m"), path)
    written(spark.sql("select null s, null l, null m").select(
        F.col("s").cast("struct<a:int,in:struct<b:string>>"), F.col("l").cast("array<struct<b:string>>"),
        F.col("m").cast("map<string,struct<b:string>>")), path)
    inner = struct(field("n", "long", "7", nullable=False), field("b", "string"))
    schema = struct(field("s", struct(field("in", inner), field("a", "long"))), field("l", T.ArrayType(inner)),
                    field("m", T.MapType(T.StringType(), inner)))
    rows = [r.asDict(recursive=True) for r in read_dataset(spark, View("dataset:" + path, schema)).orderBy("s").collect()]
    assert rows == [{"s": None, "l": None, "m": None},
                    {"s": {"in": {"n": 7, "b": "x"}, "a": 1}, "l": [{"n": 7, "b": "y"}, None], "m": {"k": {"n": 7, "b": "z"}}}]


def test_other_columns_are_pruned_and_filters_reach_the_files(spark, folder):
    path = folder("d")
    written(spark.sql("select id, named_struct('b', 'x') s from range(3)"), path)
    schema = struct(field("id", "long"), field("s", struct(field("b", "string"), field("n", "long", "1", nullable=False))))
    rows = refine(read_dataset(spark, View("dataset:" + path, schema)).select("id"), id=1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "EqualTo(id,1)" in plan
    assert rows.count() == 1


@pytest.mark.parametrize("new, message", [
    (struct(field("id", "integer")), "id is bigint, cannot become int"),
    (struct(field("id", "string")), "id is bigint, cannot become string"),
    (struct(field("s", struct(field("x", "float")))), "s.x is double, cannot become float"),
    (struct(field("s", "string")), "s is struct<x:double>, cannot become string"),
    (struct(field("l", T.ArrayType(T.ByteType()))), r"l\[\] is int, cannot become tinyint"),
    (struct(field("new", "string", nullable=False)), "new is new and required"),
    (struct(field("s", struct(field("y", "long", "1")))), "s.y is inside a record"),
])
def test_what_is_refused(new, message):
    old = struct(field("id", "long"), field("s", struct(field("x", "double"))), field("l", T.ArrayType(T.IntegerType())))
    with pytest.raises(ValueError, match=message):
        check_update(old, new)


def test_catalog_update_keeps_partitions_and_location(spark, database, tmp_path):
    uri = f"dataset:hive:{database}/gen_{uuid.uuid4().hex}"
    first = View(uri, struct(field("id", "integer"), field("gone", "string")), ("day",))
    ensure_dataset(spark, first, f"file:{tmp_path}/gen")
    table = first.parsed.table
    spark.sql(f"insert into {table} values (1, 'g', 5), (2, 'g', 6)")
    ensure_dataset(spark, View(uri, struct(field("id", "long"), field("tag", "string", "'t'")), ("day",)))
    spark.sql(f"insert into {table} values (5000000000, null, 6)")
    assert sorted(tuple(r) for r in read_dataset(spark, uri).collect()) == [(1, "t", 5), (2, "t", 6), (5000000000, None, 6)]
    assert read_view(spark, uri.replace("dataset:", "view:") + "?day=6").count() == 2
    with pytest.raises(ValueError, match="day is a partition column"):
        ensure_dataset(spark, View(uri, struct(field("id", "long"), field("day", "string")), ("day",)))
    with pytest.raises(ValueError, match="the partition columns are day"):
        ensure_dataset(spark, View(uri, struct(field("id", "long")), ("hour",)))
    assert spark.table(table).columns == ["id", "tag", "day"]
