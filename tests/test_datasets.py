"""Views read and written: slots, pruning, map columns, catalog tables."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.timeparts import nominal_literal, parts_upto
from slotwise.operators.sinks import save_nonempty, write_time_partitioned, write_view
from slotwise.operators.transforms import copy_view, count_by_key, odd_users, reconcile, row_count, union_inputs
from slotwise.schemas import EVENT, KEY_VALUES, TIME_PARTS
from slotwise.sources.datasets import (
    View, covering_partitions, ensure_dataset, list_partitions, read_at, read_dataset, read_view, refine,
)
from slotwise.sources.generator import generate_events

USER = T.StructType().add("user_id", "long").add("name", "string")
HOUR = parts_upto("hour")
HOUR_HOLES = "?year=${YEAR}&month=${MONTH}&day=${DAY}&hour=${HOUR}"
MINUTE_HOLES = HOUR_HOLES + "&minute=${MINUTE}"
NOON = "2015-05-15T12:00Z"


def users(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.col("id").alias("user_id"), F.concat(F.lit("user-"), F.col("id").cast("string")).alias("name"))


def generated(spark, *nominal_times):
    slots = spark.createDataFrame([(t,) for t in nominal_times], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("nominal_time"))
    return generate_events(slots).drop("nominal_time")


def hourly(folder, name):
    return View("view:" + folder(name) + HOUR_HOLES, USER, HOUR)


def test_copy_leaves_one_partition(spark, folder):
    source, target = hourly(folder, "in").at(NOON), hourly(folder, "out").at(NOON)
    write_view(users(spark, 10), source)
    copy_view(spark, source, target)
    out = read_dataset(spark, target)
    assert reconcile(users(spark, 10), out.select("user_id", "name")).count() == 0
    assert [tuple(r) for r in covering_partitions(out, HOUR).collect()] == [(2015, 5, 15, 12)]
    assert [tuple(r) for r in list_partitions(spark, target).collect()] == [(2015, 5, 15, 12)]
    assert os.path.isdir(folder("out").removeprefix("file:") + "/year=2015/month=5/day=15/hour=12")


def test_union_keeps_both_inputs(spark):
    both = union_inputs({"a": users(spark, 10), "b": users(spark, 10, 10).select("name", "user_id"),
                         "c": users(spark, 1)})
    assert row_count(both).first().row_count == 21
    assert both.select("user_id").distinct().count() == 20
    with pytest.raises(ValueError):
        union_inputs({})


def test_generator_and_time_partitions(spark, folder):
    dataset = View("dataset:" + folder("events"), EVENT, TIME_PARTS)
    events = generated(spark, "2015-05-07 12:00:00", "2015-05-07 12:01:00")
    write_time_partitioned(events, dataset, "timestamp")
    rows = read_at(spark, View("view:" + folder("events") + MINUTE_HOLES, EVENT, TIME_PARTS), "2015-05-07T12:01Z")
    rows = rows.orderBy("user_id").collect()
    assert [r.user_id for r in rows] == list(range(10))
    assert [r.session_id for r in rows] == [str(i) for i in range(10)]
    assert {r.timestamp for r in rows} == {dt.datetime(2015, 5, 7, 12, 1)}
    assert {(r.year, r.month, r.day, r.hour, r.minute) for r in rows} == {(2015, 5, 7, 12, 1)}


def test_time_partitions_append_or_replace(spark, folder):
    dataset = View("dataset:" + folder("events"), EVENT, HOUR)
    early, late = generated(spark, "2015-05-07 12:00:00"), generated(spark, "2015-05-07 13:00:00")
    write_time_partitioned(early.unionByName(late), dataset, "timestamp", "hour")
    write_time_partitioned(late, dataset, "timestamp", "hour", mode="append")
    counts = {r.hour: r.event_count for r in count_by_key(read_dataset(spark, dataset), "hour").collect()}
    assert counts == {12: 10, 13: 20}
    write_time_partitioned(late.limit(3), dataset, "timestamp", "hour", mode="overwrite", clustered=True)
    counts = {r.hour: r.event_count for r in count_by_key(read_dataset(spark, dataset), "hour").collect()}
    assert counts == {12: 10, 13: 3}
    with pytest.raises(ValueError):
        write_time_partitioned(late, dataset, "timestamp", "hour", mode="ignore")


def test_a_slot_is_replaced_also_by_nothing(spark, folder):
    slot, other = hourly(folder, "users").at(NOON), hourly(folder, "users").at("2015-05-15T13:00Z")
    write_view(users(spark, 10), slot)
    write_view(users(spark, 4), other)
    write_view(users(spark, 3), slot)
    assert read_view(spark, slot).count() == 3
    write_view(users(spark, 0), slot)
    assert read_view(spark, slot).count() == 0
    assert read_view(spark, other).count() == 4


def test_slot_values_come_from_the_view(spark, folder):
    slot = hourly(folder, "users").at(NOON)
    write_view(users(spark, 2).withColumn("hour", F.lit(23)), slot)
    assert {r.hour for r in read_dataset(spark, slot).collect()} == {12}
    with pytest.raises(ValueError):
        write_view(users(spark, 2), View("view:" + folder("users") + "?year=2015", USER, HOUR))


def test_constraints_are_numbers_padded_or_not(spark, folder):
    write_view(users(spark, 10), hourly(folder, "users").at(NOON))
    for query in ("?year=2015&month=05&day=15&hour=12", "?hour=12&month=5", "?year=2015&month=5&user_id=3"):
        rows = read_view(spark, View("view:" + folder("users") + query, USER, HOUR))
        assert rows.count() == (1 if "user_id" in query else 10)
    spark.range(3).select(F.col("id").alias("user_id"), F.lit("x").alias("name")).write.parquet(
        folder("padded").removeprefix("file:") + "/year=2015/month=05/day=15/hour=12")
    assert read_at(spark, hourly(folder, "padded"), NOON).count() == 3


def test_view_without_data_is_empty_but_a_missing_dataset_is_an_error(spark, folder):
    write_view(users(spark, 10), hourly(folder, "users").at(NOON))
    empty = read_at(spark, hourly(folder, "users"), "2016-01-01T00:00Z")
    assert empty.count() == 0
    assert empty.columns == ["user_id", "name", *HOUR]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_at(spark, hourly(folder, "nothing"), NOON)
    with pytest.raises(ValueError, match="holes"):
        read_view(spark, hourly(folder, "users"))


def test_reading_a_slot_prunes(spark, folder):
    for hour in range(3):
        write_view(users(spark, 5), hourly(folder, "users").at(f"2015-05-15T{hour:02}:00Z"))
    one = read_at(spark, hourly(folder, "users"), "2015-05-15T01:00Z")
    assert len(one.inputFiles()) <= 8 and all("/hour=1/" in f for f in one.inputFiles())
    plan = refine(read_dataset(spark, hourly(folder, "users")), hour=1, user_id=3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and "EqualTo(user_id,3)" in plan


def test_refine_on_a_data_field(spark):
    session = uuid.uuid4().hex
    events = generated(spark, "2015-05-07 12:00:00")
    sent = events.withColumn("session_id", F.lit(session))
    assert reconcile(sent, refine(events.unionByName(sent), session_id=session)).count() == 0
    assert refine(events).count() == 10


def test_odd_users(spark):
    ids = spark.createDataFrame([(i,) for i in (-3, -2, -1, 0, 1, 2, 3, None)], "user_id long")
    assert [r.user_id for r in odd_users(ids).collect()] == [1, 3]


def test_reconcile_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 2), ("new", 4)], "v string, k int")
    got = {(r.k, r.v, r.side, r.copies) for r in reconcile(a, b).collect()}
    assert got == {(1, "x", "missing", 1), (3, "z", "missing", 1), (2, None, "unexpected", 1), (4, "new", "unexpected", 1)}


def test_map_columns(spark, folder):
    dataset = View("dataset:" + folder("kv"), KEY_VALUES)
    row = ({"app": "1", "job": "2"}, None, {"app": "1", "out": "3"})
    write_view(spark.createDataFrame([row], KEY_VALUES), dataset)
    assert tuple(read_dataset(spark, dataset).first()) == row


def test_save_nonempty(spark, folder):
    dataset = View("dataset:" + folder("saved"), USER)
    assert not save_nonempty(users(spark, 0), dataset)
    assert not os.path.exists(folder("saved").removeprefix("file:"))
    assert save_nonempty(users(spark, 3), dataset)
    assert save_nonempty(users(spark, 3), dataset)
    assert read_dataset(spark, dataset).count() == 6
    slot = hourly(folder, "slots").at(NOON)
    assert not save_nonempty(users(spark, 0), slot)
    assert not [name for name in os.listdir(folder("slots").removeprefix("file:")) if name.startswith("year")]
    assert save_nonempty(users(spark, 3), slot) and not save_nonempty(users(spark, 0), slot)
    assert read_view(spark, slot).count() == 3


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_catalog_dataset(spark, database):
    uri = f"hive:{database}/users"
    dataset = View("dataset:" + uri, USER, HOUR)
    ensure_dataset(spark, dataset)
    ensure_dataset(spark, dataset)
    slot = View("view:" + uri + HOUR_HOLES).at(NOON)
    write_view(users(spark, 10), slot)
    write_view(users(spark, 4), View("view:" + uri + HOUR_HOLES).at("2015-05-15T13:00Z"))
    assert read_view(spark, slot).count() == 10
    assert {tuple(r) for r in list_partitions(spark, slot).collect()} == {(2015, 5, 15, 12), (2015, 5, 15, 13)}
    write_view(users(spark, 0), slot)
    assert read_view(spark, slot).count() == 0
    assert read_dataset(spark, dataset).count() == 4
    assert [tuple(r) for r in covering_partitions(read_dataset(spark, dataset), HOUR).collect()] == [(2015, 5, 15, 13)]
    assert save_nonempty(users(spark, 2), slot)
    assert read_view(spark, slot).count() == 2


def test_ensure_dataset_adds_columns(spark, database, tmp_path):
    uri = f"dataset:hive:{database}/users"
    location = f"file:{tmp_path}/users"
    ensure_dataset(spark, View(uri, USER, HOUR), location=location)
    write_view(users(spark, 2), View(uri.replace("dataset:", "view:") + HOUR_HOLES).at(NOON))
    wider = T.StructType([*USER.fields, T.StructField("mail", T.StringType())])
    ensure_dataset(spark, View(uri, wider, HOUR))
    rows = read_dataset(spark, uri).collect()
    assert len(rows) == 2 and {r.mail for r in rows} == {None}
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.users").where("col_name = 'Location'").first().data_type
    assert described.rstrip("/") == location
    write_view(users(spark, 1).withColumn("mail", F.lit("m")), View(uri.replace("dataset:", "view:") + HOUR_HOLES).at(NOON))
    assert [r.mail for r in read_dataset(spark, uri).collect()] == ["m"]
    changed = T.StructType([T.StructField("user_id", T.StringType()), *wider.fields[1:]])
    with pytest.raises(ValueError, match="cannot become"):
        ensure_dataset(spark, View(uri, changed, HOUR))
    ensure_dataset(spark, View(uri, USER, HOUR))
    assert read_dataset(spark, uri).columns == [*USER.names, *HOUR]


def test_hot_slot_is_split_over_tasks(spark, folder):
    """Most rows in one hour: the rebalance spreads them over several files, and no row is lost."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        rows = spark.range(0, 300_000, 1, 8).select(
            F.col("id").alias("user_id"), F.sha2(F.col("id").cast("string"), 256).alias("name"),
            (nominal_literal("2015-05-07T00:00") + F.make_dt_interval(
                hours=F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 20).cast("int")))).alias("ts"))
        dataset = View("dataset:" + folder("hot"), T.StructType([*USER.fields, T.StructField("ts", T.TimestampNTZType())]), HOUR)
        write_time_partitioned(rows, dataset, "ts", "hour")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256m")
    back = read_dataset(spark, dataset)
    assert back.count() == 300_000
    assert len(refine(back, hour=0).inputFiles()) > 4


def test_slots_named_by_text(spark, folder, database):
    """A partition column may be text: its value goes into folder names and statements as such."""
    for dataset in (folder("regions"), f"hive:{database}/regions"):
        schema = T.StructType([*USER.fields, T.StructField("region", T.StringType()),
                               T.StructField("day", T.IntegerType())])
        view = View(f"view:{dataset}?region=eu-west&day=5", schema, ("region", "day"))
        ensure_dataset(spark, view.dataset())
        write_view(users(spark, 3), view)
        write_view(users(spark, 1), View(f"view:{dataset}?region=us&day=05", schema, ("region", "day")))
        save_nonempty(users(spark, 2), view)
        assert read_view(spark, view).count() == 5
        assert {(r.region, r.day) for r in read_dataset(spark, view).collect()} == {("eu-west", 5), ("us", 5)}
    with pytest.raises(ValueError, match="cannot name a slot"):
        write_view(users(spark, 1), View("view:" + folder("regions") + "?region=a%2Fb&day=5", schema, ("region", "day")))


def test_text_values_are_not_numbers(spark, folder):
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("code", T.StringType())])
    view = lambda code: View("view:" + folder("codes") + f"?code={code}", schema, ("code",))
    for n, code in enumerate(("007", "07", "7"), 1):
        write_view(spark.range(n).select(F.col("id").alias("user_id")), view(code))
    assert [read_view(spark, view(code)).count() for code in ("007", "07", "7", "0007")] == [1, 2, 3, 0]
    write_view(spark.range(0).select(F.col("id").alias("user_id")), view("07"))
    assert [read_view(spark, view(code)).count() for code in ("007", "07", "7")] == [1, 0, 3]
    assert sorted(r.code for r in list_partitions(spark, view("7")).collect()) == ["007", "7"]


def test_partitions_are_listed_without_opening_files(spark, folder):
    for hour in range(3):
        write_view(users(spark, 5), hourly(folder, "users").at(f"2015-05-15T{hour:02}:00Z"))
    listed = list_partitions(spark, hourly(folder, "users"))
    assert sorted(tuple(r) for r in listed.collect()) == [(2015, 5, 15, hour) for hour in range(3)]
    assert "parquet" not in listed._jdf.queryExecution().executedPlan().toString().split("Location")[0].lower()
