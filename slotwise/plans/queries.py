"""Queries over the given tables, one or more for each operator. Each takes a session and the tables' folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.cron import CronFields, audit_schedules, next_fire, slot_of, with_cron_fields
from slotwise.functions.timeparts import (
    format_nominal, from_millis, nominal_literal, parse_nominal, parts_upto, render_template, slot_time, to_millis,
    with_time_parts,
)
from slotwise.functions.uris import parse_view_uri
from slotwise.operators.as_of import running_totals
from slotwise.operators.positions import reconcile_in_order
from slotwise.operators.readiness import (
    compact_marks, mark_views, missing_slots, pending_slots, ready_marks, ready_slots,
)
from slotwise.operators.sinks import append, save_nonempty, write_time_partitioned, write_view
from slotwise.operators.slots import events_per_slot, fire_slots, instance_at, is_slot, slot_column, slots_with_data
from slotwise.operators.transforms import copy_view, count_by_key, keys, odd_users, reconcile, row_count, union_inputs
from slotwise.plans.jobs import Job, Schedule, backfill, compact_stream, due_in_waves, job, run_at, run_stream
from slotwise.plans.runs import emit
from slotwise.session import work_path
from slotwise.sources.datasets import (
    View, ensure_dataset, list_partitions, read_at, read_dataset, read_view, refine,
)
from slotwise.sources.evolution import field
from slotwise.sources.generator import generate_events
from slotwise.sources.topics import Topic, read_topic, write_topic
from slotwise.streaming.sinks import for_each_batch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def record(**fields: str) -> T.StructType:
    schema = T.StructType()
    for name, kind in fields.items():
        schema.add(name, kind)
    return schema


EVENTS = record(event_id="long", ts="timestamp_ntz", user_id="long", event_type="string", value="double",
                props="string")
ORDERS = record(o_orderkey="long", o_custkey="long", o_orderstatus="string", o_totalprice="double",
                o_orderdate="timestamp_ntz", o_orderpriority="string")
CUSTOMER = record(c_custkey="long", c_name="string", c_nationkey="integer", c_acctbal="double",
                  c_mktsegment="string")
GENERATED = record(user_id="long", session_id="string", timestamp="timestamp_ntz")
REPORT = record(user_id="long", event_count="long")

DAY = parts_upto("day")
DAY_HOLES = "?year=${YEAR}&month=${MONTH}&day=${DAY}"
TEMPLATE = "view:hive:shop/visits?year=${YEAR}&month=${MONTH}&day=${DAY}&hour=${HOUR}&minute=${MINUTE}"

# A slot of the events table, and a run after its last event.
SLOT_DAY = "2024-01-15T00:00Z"
REPORT_TIME = "2024-01-31T00:05Z"


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")


def new_dataset(spark: SparkSession, label: str, schema: T.StructType, parts: tuple[str, ...] = ()) -> View:
    return View("dataset:" + work_path(spark, label), schema, parts)


def view_of(dataset: View, query_text: str) -> View:
    return View("view:" + dataset.name + query_text, dataset.schema, dataset.parts)


#: Datasets that queries share, by session and folder of tables; only what a bench prepares is in here.
PREPARED: dict[tuple[str, str], View] = {}


def events_by_day(spark: SparkSession, sf_dir: str) -> View:
    """The events table written as a dataset partitioned by day; a prepared one is used as it is, for none changes it."""
    return PREPARED.get((spark.sparkContext.applicationId, sf_dir)) or _written_by_day(spark, sf_dir)


def _written_by_day(spark: SparkSession, sf_dir: str) -> View:
    dataset = new_dataset(spark, "events", EVENTS, DAY)
    write_time_partitioned(events(spark, sf_dir), dataset, "ts", "day")
    return dataset


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the dataset that most queries start from, so that a bench times the queries and not this write."""
    PREPARED[spark.sparkContext.applicationId, sf_dir] = _written_by_day(spark, sf_dir)


# Sources, projections and filters


@query("event_count_by_user")
def event_count_by_user(spark, sf_dir):
    return count_by_key(events(spark, sf_dir), "user_id")


@query("event_keys")
def event_keys(spark, sf_dir):
    return keys(events(spark, sf_dir), "user_id")


@query("row_count")
def event_row_count(spark, sf_dir):
    return row_count(events(spark, sf_dir))


@query("view_scan_one_day")
def view_scan_one_day(spark, sf_dir):
    return read_view(spark, view_of(events_by_day(spark, sf_dir), "?year=2024&month=1&day=15"))


@query("view_scan_one_hour")
def view_scan_one_hour(spark, sf_dir):
    """Constraints on folders and on a field: the day is listed, the hour is a filter in the scan."""
    schema = T.StructType([*EVENTS.fields, T.StructField("hour", T.IntegerType())])
    dataset = new_dataset(spark, "events", schema, DAY)
    with_hour = events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    write_time_partitioned(with_hour, dataset, "ts", "day")
    return read_view(spark, view_of(dataset, "?year=2024&month=1&day=15&hour=12"))


@query("read_at_nominal")
def read_at_nominal(spark, sf_dir):
    return read_at(spark, view_of(events_by_day(spark, sf_dir), DAY_HOLES), "2024-01-20T12:30Z")


@query("read_whole_dataset")
def read_whole_dataset(spark, sf_dir):
    return read_dataset(spark, events_by_day(spark, sf_dir))


@query("refine_partition_and_data")
def refine_partition_and_data(spark, sf_dir):
    dataset = read_dataset(spark, events_by_day(spark, sf_dir))
    return refine(dataset, month=1, event_type="click")


@query("covering_partitions")
def covering_partitions_of_events(spark, sf_dir):
    return list_partitions(spark, events_by_day(spark, sf_dir))


@query("rows_per_partition")
def rows_per_partition(spark, sf_dir):
    return count_by_key(read_dataset(spark, events_by_day(spark, sf_dir)), *DAY)


@query("rows_per_hour")
def rows_per_hour(spark, sf_dir):
    hourly = with_time_parts(events(spark, sf_dir), "ts", "hour")
    return count_by_key(hourly, *parts_upto("hour"))


@query("odd_users")
def odd_user_events(spark, sf_dir):
    return odd_users(events(spark, sf_dir))


@query("example_events")
def example_events(spark, sf_dir):
    return _example_events(events(spark, sf_dir))


def _example_events(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("event_id").cast("string").alias("session_id"), F.col("ts").alias("timestamp"))


@query("generate_events")
def generated_events(spark, sf_dir):
    minutes = events(spark, sf_dir).select(slot_of(F.col("ts"), "* * * * *").alias("nominal_time")).distinct()
    dataset = new_dataset(spark, "generated", GENERATED, DAY)
    write_time_partitioned(generate_events(minutes).drop("nominal_time"), dataset, "timestamp", "day")
    return read_dataset(spark, dataset)


# Sets


@query("copy_view")
def copied_view(spark, sf_dir):
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "copy", EVENTS, DAY)
    copy_view(spark, view_of(source, "?year=2024&month=1&day=15"), view_of(target, "?year=2024&month=2&day=1"))
    return read_dataset(spark, target)


@query("union_inputs")
def union_of_inputs(spark, sf_dir):
    """A dynamic job: inputs are named at run time, rows in two of them are kept twice."""
    merge = Job("merge-inputs", lambda **inputs: union_inputs(inputs), inputs=None, outputs={"output": None})
    source = new_dataset(spark, "source", EVENTS)
    write_view(events(spark, sf_dir), source)
    target = new_dataset(spark, "merged", EVENTS, DAY)
    run_at(spark, merge, SLOT_DAY,
           {"clicks": view_of(source, "?event_type=click"), "errors": view_of(source, "?event_type=error"),
            "all": source},
           {"output": view_of(target, DAY_HOLES)})
    return read_dataset(spark, target)


@query("reconcile")
def reconciled(spark, sf_dir):
    """Sent: every event, purchases twice. Arrived: no errors, signups twice."""
    sent = events(spark, sf_dir)
    expected = sent.unionByName(sent.where("event_type = 'purchase'"))
    actual = sent.where("event_type <> 'error'").unionByName(sent.where("event_type = 'signup'"))
    return reconcile(expected, actual)


@query("reconcile_round_trip")
def reconciled_round_trip(spark, sf_dir):
    """Differences between a dataset read back and the table it was written from: none."""
    return row_count(reconcile(events(spark, sf_dir), read_dataset(spark, events_by_day(spark, sf_dir)).drop(*DAY)))


@query("reconcile_in_order")
def reconciled_in_order(spark, sf_dir):
    """Sent in the order of their ids; every tenth pair of neighbours arrived the other way round."""
    sent = events(spark, sf_dir).select("event_id", F.col("event_id").alias("turn"), "event_type", "value")
    swapped = F.floor(F.col("event_id") / 2) % 10 == 0
    arrived = sent.withColumn("turn", F.when(swapped, F.col("event_id").bitwiseXOR(F.lit(1))).otherwise(F.col("event_id")))
    found = reconcile_in_order(sent, arrived, ["turn"])
    return found.select("position", F.col("expected.event_id").alias("expected_id"), F.col("actual.event_id").alias("actual_id"))


# Scalar functions


@query("time_parts")
def time_parts_of_events(spark, sf_dir):
    return with_time_parts(events(spark, sf_dir).select("event_id", "ts"), "ts").drop("ts")


@query("time_parts_of_orders")
def time_parts_of_orders(spark, sf_dir):
    return with_time_parts(orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("slot_time")
def slot_time_of_parts(spark, sf_dir):
    parts = with_time_parts(events(spark, sf_dir).select("event_id", "ts"), "ts")
    return parts.select("event_id", slot_time(parts_upto("minute")).alias("nominal_time"))


@query("render_template")
def rendered_template(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", render_template(TEMPLATE, F.col("ts")).alias("uri"))


@query("render_template_padded")
def rendered_template_padded(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", render_template(TEMPLATE, F.col("ts"), padded=True).alias("uri"))


@query("render_template_column")
def rendered_template_column(spark, sf_dir):
    template = F.concat(F.lit("view:hive:shop/"), F.col("event_type"), F.lit("?day=${DAY}&hour=${HOUR}"))
    return events(spark, sf_dir).select("event_id", render_template(template, F.col("ts")).alias("uri"))


@query("parse_view_uri")
def parsed_view_uri(spark, sf_dir):
    """URIs with and without host and constraints, one with a key twice, one without a value, and a text that is none."""
    uri = (F.when(F.col("event_type") == "click", F.lit("view:hive://catalog.local:9083/shop/visits?year=${YEAR}&year=${MONTH}&day=${DAY}"))
           .when(F.col("event_type") == "view", F.lit("view:hdfs:///lake/visits?year=${YEAR}&month=${MONTH}&hour&day=${DAY}"))
           .when(F.col("event_type") == "error", F.lit("dataset:hive:shop/visits"))
           .when(F.col("event_type") == "signup", F.lit("no scheme, year=${YEAR}"))
           .otherwise(F.lit(TEMPLATE)))
    rendered = events(spark, sf_dir).select("event_id", render_template(uri, F.col("ts")).alias("uri"))
    parsed = rendered.withColumn("uri", parse_view_uri(F.col("uri")))
    return parsed.select(
        "event_id", "uri.kind", "uri.store", "uri.authority", "uri.path",
        *(F.col("uri.constraints").getItem(part).alias(part) for part in ("year", "month", "day", "hour", "minute")))


@query("format_nominal")
def formatted_nominal(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", format_nominal(F.col("ts")).alias("nominal"))


@query("parse_nominal")
def parsed_nominal(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm"), F.lit("Z"))
    return events(spark, sf_dir).select("event_id", parse_nominal(text).alias("nominal_time"))


@query("epoch_millis")
def epoch_millis(spark, sf_dir):
    millis = to_millis(F.col("ts"))
    return events(spark, sf_dir).select("event_id", millis.alias("millis"), from_millis(millis).alias("ts_millis"))


# Schedules


def _next_fire(cron: str, inclusive: bool = False) -> Query:
    def run(spark, sf_dir):
        return events(spark, sf_dir).select(
            "event_id", next_fire(F.col("ts"), cron, inclusive).alias("next_fire"))
    return run


QUERIES["next_fire_minutely"] = _next_fire("* * * * *")
QUERIES["next_fire_five_minutes"] = _next_fire("*/5 * * * *")
QUERIES["next_fire_hourly"] = _next_fire("0 * * * *")
QUERIES["next_fire_every_six_hours"] = _next_fire("30 */6 * * *")
QUERIES["next_fire_daily"] = _next_fire("0 1 * * *")

# Schedules given to events and customers in turn.
CRONS = ("* * * * *", "*/7 * * * *", "0 * * * *", "17 */5 * * *", "59 23 * * *", "30 9 * * *", "0 12 */7 * *",
         "*/20 9 * * *", "5 */24 * * *")
COARSE_CRONS = ("0 * * * *", "30 */6 * * *", "15 3 * * *", "0 12 */7 * *", "17 */5 * * *", "*/20 9 * * *")


def _in_turn(number: str, crons: tuple[str, ...]) -> Column:
    listed = F.array(*(F.lit(cron) for cron in crons))
    return F.get(listed, (F.col(number) % len(crons)).cast("int"))


def _events_with_schedules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CronFields]:
    return with_cron_fields(events(spark, sf_dir).withColumn("cron", _in_turn("event_id", CRONS)))


@query("next_fire_by_schedule")
def next_fire_by_schedule(spark, sf_dir):
    df, fields = _events_with_schedules(spark, sf_dir)
    return df.select("event_id", "cron", next_fire(F.col("ts"), fields).alias("next_fire"))


@query("next_fire_inclusive_by_schedule")
def next_fire_inclusive_by_schedule(spark, sf_dir):
    """At exact minutes, where a slot on the minute is its own next one."""
    df, fields = _events_with_schedules(spark, sf_dir)
    df = df.withColumn("minute", slot_of(F.col("ts"), "* * * * *"))
    return df.select("event_id", "cron", next_fire(F.col("minute"), fields, inclusive=True).alias("next_fire"))


@query("slot_by_schedule")
def slot_by_schedule(spark, sf_dir):
    df, fields = _events_with_schedules(spark, sf_dir)
    return df.select("event_id", "cron", slot_of(F.col("ts"), fields).alias("slot"))


@query("audit_schedules")
def audited_schedules(spark, sf_dir):
    """A schedule text per customer, valid ones and all kinds of invalid ones."""
    n = F.col("c_custkey")

    def pick(number: Column, *choices: str | Column) -> Column:
        listed = F.array(*(F.lit(c) if isinstance(c, str) else c for c in choices))
        return F.get(listed, (number % len(choices)).cast("int"))

    def text(number: Column) -> Column:
        return number.cast("string")

    minute = pick(n, "*", F.concat(F.lit("*/"), text(n % 13)), text(n % 64), "1-5", text(n % 60), "*/99999999999")
    hour = pick(F.floor(n / 6), "*", F.concat(F.lit("*/"), text(n % 9)), text(n % 26), "x", "*")
    day = pick(F.floor(n / 30), "*", "*/7", "15", "*")
    rest = pick(F.floor(n / 120), "* *", "* *", "* *", "* 1", "*", "* * ")
    schedules = customer(spark, sf_dir).select("c_custkey", F.concat_ws(" ", minute, hour, day, rest).alias("cron"))
    return audit_schedules(schedules).fillna({"reason": "", "every": 0, "unit": ""})


@query("fire_slots")
def fired_slots(spark, sf_dir):
    """One schedule per customer, each over its own days."""
    start = F.timestamp_add("MINUTE", (F.col("c_custkey") * 37) % 20000, nominal_literal("2024-01-01T00:00:30"))
    schedules = customer(spark, sf_dir).select(
        "c_custkey", _in_turn("c_custkey", COARSE_CRONS).alias("cron"), start.alias("start_at"),
        F.timestamp_add("DAY", F.col("c_custkey") % 5 + 1, start).alias("end_at"))
    return fire_slots(schedules).select("c_custkey", "cron", "nominal_time")


def _events_per_slot(cron: str) -> Query:
    return lambda spark, sf_dir: events_per_slot(events(spark, sf_dir), cron)


QUERIES["events_per_slot"] = _events_per_slot("*/5 * * * *")
QUERIES["events_per_slot_uneven"] = _events_per_slot("17 */5 * * *")


@query("is_slot")
def events_on_slots(spark, sf_dir):
    """Whether the minute of an event is a slot of its schedule, all fields looked at."""
    df = events(spark, sf_dir).select(
        "event_id", slot_of(F.col("ts"), "* * * * *").alias("minute"), _in_turn("event_id", CRONS).alias("cron"))
    df, fields = with_cron_fields(df)
    return df.select("event_id", is_slot(F.col("minute"), fields).cast("int").alias("on_slot"))


@query("instance_at")
def instance_of_run(spark, sf_dir):
    nominal = F.col("nominal_time")
    runs = events(spark, sf_dir).select("event_id", slot_of(F.col("ts"), "* * * * *").alias("nominal_time"))
    return runs.select(
        "event_id", "nominal_time",
        instance_at(nominal, nominal_literal("2024-01-01T00:03"), "*/7 * * * *").alias("seven_minutes"),
        instance_at(nominal, nominal_literal("2024-01-10T12:00"), "0 12 */7 * *").alias("seven_days"))


# Readiness


def _schedule_over(df: DataFrame, cron: str) -> DataFrame:
    """The slots of a schedule from the first event to the last."""
    one = df.agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at")).withColumn("cron", F.lit(cron))
    return fire_slots(one).select("nominal_time")


def _marks_by_type(spark: SparkSession, sf_dir: str) -> View:
    """Marks in which each event type is a view, ready in the hours that have such events."""
    markers = new_dataset(spark, "markers", None)
    hour = slot_column("ts", "0 * * * *").alias("nominal_time")
    mark_views(events(spark, sf_dir).select(F.col("event_type").alias("view"), hour).distinct(), markers)
    return markers


@query("ready_marks")
def marked_slots(spark, sf_dir):
    markers = _marks_by_type(spark, sf_dir)
    return ready_marks(spark, markers, "purchase")


@query("compacted_marks")
def compacted_marks(spark, sf_dir):
    """Marks of two runs, made one folder."""
    markers = _marks_by_type(spark, sf_dir)
    mark_views(ready_marks(spark, markers, "purchase").select(F.lit("purchase").alias("view"), "nominal_time"), markers)
    compact_marks(spark, markers, ["purchase"])
    return ready_marks(spark, markers, "purchase")


@query("ready_slots")
def ready_hours(spark, sf_dir):
    markers = _marks_by_type(spark, sf_dir)
    ready = {name: ready_marks(spark, markers, name) for name in ("click", "error", "purchase", "signup", "view")}
    return ready_slots(_schedule_over(events(spark, sf_dir), "0 * * * *"), ready)


@query("missing_slots")
def missing_five_minutes(spark, sf_dir):
    df = events(spark, sf_dir)
    return missing_slots(_schedule_over(df, "*/5 * * * *"), slots_with_data(df, "*/5 * * * *"))


@query("pending_slots")
def pending_hours(spark, sf_dir):
    markers = _marks_by_type(spark, sf_dir)
    inputs = {name: ready_marks(spark, markers, name) for name in ("click", "view")}
    outputs = {"purchase": ready_marks(spark, markers, "purchase")}
    return pending_slots(_schedule_over(events(spark, sf_dir), "0 * * * *"), inputs, outputs)


@query("due_in_waves")
def due_in_waves_of_a_chain(spark, sf_dir):
    """Three jobs, each waiting for the one before: hourly, every six hours, daily. Some hours are done already."""
    markers = new_dataset(spark, "markers", None)
    clicks, hourly, sixth, daily = (View(f"view:hdfs:///shop/{name}{DAY_HOLES}&hour=${{HOUR}}") for name in ("clicks", "a", "b", "c"))
    hour = slot_column("ts", "0 * * * *").alias("nominal_time")
    for kind, view in (("click", clicks), ("error", hourly)):
        mark_views(events(spark, sf_dir).where(F.col("event_type") == kind).select(F.lit(view.marks).alias("view"), hour).distinct(), markers)

    def step(name: str, *inputs: str) -> Job:
        return Job(name, lambda **given: given, dict.fromkeys(inputs), {"out": None})

    chain = [
        Schedule(step("daily", "sixth", "clicks"), "0 0 * * *", outputs={"out": daily}, inputs={"sixth": sixth, "clicks": clicks}),
        Schedule(step("hourly", "clicks"), "0 * * * *", outputs={"out": hourly}, inputs={"clicks": clicks}),
        Schedule(step("sixth", "hourly"), "30 */6 * * *", outputs={"out": sixth}, inputs={"hourly": hourly},
                 input_crons={"hourly": "0 * * * *"}),
    ]
    chain[0] = Schedule(chain[0].job, "0 0 * * *", outputs=chain[0].outputs, inputs=chain[0].inputs,
                        input_crons={"sixth": "30 */6 * * *"}, start_at="2023-12-31T00:00Z")
    return due_in_waves(spark, chain, markers, "2024-01-01T00:00Z", "2024-01-20T00:00Z")


# Sinks and jobs


@job("odd-users", inputs={"example_events": EVENTS}, outputs={"odd_users": EVENTS})
def odd_users_job(example_events):
    return odd_users(example_events)


@job("cumulative-report", inputs=["example_events"], outputs=["report"])
def report_job(example_events):
    return count_by_key(example_events, "user_id")


@job("report-per-slot", inputs=["example_events"], outputs=["report"])
def slot_report_job(example_events):
    return count_by_key(example_events, "nominal_time", "user_id")


@job("late-days", inputs=["example_events"], outputs=["odd_users"])
def late_days_job(example_events):
    return example_events.where(F.dayofmonth("nominal_time") > 15)


@job("clicks", inputs={"example_events": EVENTS}, outputs={"clicks": EVENTS})
def clicks_job(example_events):
    return example_events.where("event_type = 'click'")


@job("reversed", inputs={"example_events": EVENTS}, outputs=["reversed_events"])
def record_function_job(example_events):
    """The low 16 bits of event_id the other way round, a batch at a time."""
    def reversed_bits(batches):
        for batch in batches:
            ids = batch["event_id"].to_numpy()
            bits = [(ids >> i & 1) << 15 - i for i in range(16)]
            yield batch.assign(reversed=sum(bits))

    schema = T.StructType([*example_events.schema.fields, T.StructField("reversed", T.LongType())])
    return example_events.mapInPandas(reversed_bits, schema)


def _days(spark: SparkSession, dataset: View) -> DataFrame:
    return list_partitions(spark, dataset).select(slot_time(DAY).alias("nominal_time"))


def _work_table(spark: SparkSession, label: str, schema: T.StructType, parts: tuple[str, ...]) -> View:
    """A new catalog table with its files in the shared folder and a name of its own."""
    location = work_path(spark, label)
    view = View(f"dataset:hive:slotwise_work/{label}_{location.rpartition('-')[2]}", schema, parts)
    return ensure_dataset(spark, view, location)


def _kept(spark: SparkSession, rows: DataFrame, table: View) -> DataFrame:
    """Rows of a work table, kept when the table's name goes."""
    kept = _written(spark, rows)
    spark.sql(f"DROP TABLE {table.parsed.table}")
    return kept


@query("backfill_catalog")
def backfill_catalog(spark, sf_dir):
    """As ``backfill_again``, into a catalog table."""
    source = events_by_day(spark, sf_dir)
    target = _work_table(spark, "odd", EVENTS, DAY)
    for step in (odd_users_job, late_days_job):
        backfill(spark, step, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
                 {"odd_users": view_of(target, DAY_HOLES)})
    return _kept(spark, read_dataset(spark, target), target)


@query("list_partitions")
def listed_partitions(spark, sf_dir):
    """Partitions as the catalog lists them."""
    target = _work_table(spark, "events", EVENTS, DAY)
    write_time_partitioned(events(spark, sf_dir), target, "ts", "day")
    return _kept(spark, list_partitions(spark, target), target)


@query("due_by_constrained_view")
def due_by_constrained_view(spark, sf_dir):
    """Clicks are written and marked, views are not: only jobs that wait for clicks are due."""
    source = events_by_day(spark, sf_dir)
    by_type = new_dataset(spark, "by_type", EVENTS, ("event_type", *DAY))
    target = new_dataset(spark, "odd", EVENTS, DAY)
    markers = new_dataset(spark, "markers", None)

    def of_type(kind: str) -> View:
        return view_of(by_type, DAY_HOLES.replace("?", f"?event_type={kind}&"))

    backfill(spark, clicks_job, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
             {"clicks": of_type("click")}, markers)
    due = [
        Schedule(odd_users_job, "0 0 * * *", outputs={"odd_users": view_of(target, DAY_HOLES)},
                 inputs={"example_events": of_type(kind)})
        .due(spark, markers, "2024-01-01T23:00Z", "2024-01-25T00:00Z").select(F.lit(kind).alias("event_type"), "nominal_time")
        for kind in ("click", "view")]
    return due[0].unionByName(due[1])


@query("record_function_in_job")
def record_function_in_job(spark, sf_dir):
    """A job that calls Python, a batch of records at a time."""
    source = events_by_day(spark, sf_dir)
    schema = T.StructType([*EVENTS.fields, T.StructField("reversed", T.LongType())])
    target = new_dataset(spark, "reversed", schema, DAY)
    backfill(spark, record_function_job, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
             {"reversed_events": view_of(target, DAY_HOLES)}, clustered=True)
    return read_dataset(spark, target)


@query("view_scan_text_partition")
def view_scan_text_partition(spark, sf_dir):
    """Slots named by text: 007, 07 and 7 are three, in folders and in the catalog."""
    fields = [f for f in CUSTOMER.fields if f.name != "c_nationkey"]
    schema = T.StructType([*fields, T.StructField("code", T.StringType())])
    folders, slots = (new_dataset(spark, label, schema, ("code",)) for label in ("folders", "slots"))
    rows = customer(spark, sf_dir)
    padded = rows.withColumn("code", F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).drop("c_nationkey")
    append(padded, folders, ("code",))
    for nation, code in ((7, "007"), (8, "07"), (9, "7")):
        write_view(rows.where(F.col("c_nationkey") == nation).drop("c_nationkey"), view_of(slots, f"?code={code}"))
    table = _work_table(spark, "customers", schema, ("code",))
    for nation, code in ((7, "007"), (8, "7")):
        write_view(rows.where(F.col("c_nationkey") == nation).drop("c_nationkey"), view_of(table, f"?code={code}"))
    found = {
        "folders": read_view(spark, view_of(folders, "?code=007")),
        "slots": read_dataset(spark, slots),
        "one slot": read_view(spark, view_of(slots, "?code=07")),
        "catalog": _kept(spark, read_view(spark, view_of(table, "?code=007")), table),
    }
    parts = [df.select(F.lit(store).alias("store"), "c_custkey", "code") for store, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("report_into_slot")
def report_into_slot(spark, sf_dir):
    """Events per user over the whole dataset, filed under the run's nominal time."""
    source = new_dataset(spark, "events", EVENTS)
    write_view(events(spark, sf_dir), source)
    target = new_dataset(spark, "report", REPORT, parts_upto("minute"))
    holes = DAY_HOLES + "&hour=${HOUR}&minute=${MINUTE}"
    run_at(spark, report_job, REPORT_TIME, {"example_events": source}, {"report": view_of(target, holes)})
    return read_dataset(spark, target)


@job("report-as-of", inputs=["example_events"], outputs=["report"])
def report_as_of_job(example_events, slots):
    return running_totals(example_events, slots, ["user_id"], "ts")


@query("backfill_report_as_of")
def backfill_report_as_of(spark, sf_dir):
    """The report over the whole dataset for many days at once: each sees what had happened before it."""
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "report", REPORT, DAY)
    schedule = Schedule(report_as_of_job, "0 0 * * *", inputs={"example_events": source},
                        outputs={"report": view_of(target, DAY_HOLES)})
    schedule.backfill(spark, schedule.slots(spark, "2024-01-02T12:00Z", "2024-02-03T00:00Z"))
    return read_dataset(spark, target)


@job("sort-out", inputs=["example_events"], outputs=["clicks", "dear", "users"])
def sort_out_job(example_events):
    """Three outputs of the same rows: some records, others, and two fields of all."""
    return emit(example_events, clicks=F.col("event_type") == "click", dear=F.col("value") > 50,
                users=(["event_id", "user_id", "nominal_time"], None))


USERS = record(event_id="long", user_id="long")


def _sorted_out(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("output"), "event_id", "user_id", *DAY) for name, df in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("several_outputs")
def several_outputs(spark, sf_dir):
    """A job with three outputs, computed once for all of them."""
    source = events_by_day(spark, sf_dir)
    targets = {name: new_dataset(spark, name, USERS if name == "users" else EVENTS, DAY) for name in sort_out_job.outputs}
    backfill(spark, sort_out_job, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
             {name: view_of(target, DAY_HOLES) for name, target in targets.items()})
    return _sorted_out(spark, {name: read_dataset(spark, target) for name, target in targets.items()})


@query("broken_run_healed")
def broken_run_healed(spark, sf_dir):
    """A run whose second output has no table: nothing is marked. Once it has one, the next run finishes what broke."""
    source = events_by_day(spark, sf_dir)
    markers = new_dataset(spark, "markers", None)
    targets = {name: new_dataset(spark, name, USERS if name == "users" else EVENTS, DAY) for name in ("clicks", "users")}
    name = work_path(spark, "dear").rpartition("-")[2]
    targets["dear"] = View(f"dataset:hive:slotwise_work/dear_{name}", EVENTS, DAY)
    heal = Job(f"heal-{name}", sort_out_job.function, sort_out_job.inputs, sort_out_job.outputs)
    inputs = {"example_events": view_of(source, DAY_HOLES)}
    outputs = {name: view_of(targets[name], DAY_HOLES) for name in heal.outputs}

    def marked() -> int:
        return sum(ready_marks(spark, markers, view.known(spark).marks).count() for view in outputs.values())

    try:
        backfill(spark, heal, _days(spark, source), inputs, outputs, markers)
        raise AssertionError("a run without a table for its output must fail")
    except AnalysisException:
        broken = marked()
    ensure_dataset(spark, targets["dear"], work_path(spark, "dear"))
    # One slot is asked for; all of the broken run's slots are there afterwards.
    backfill(spark, heal, _days(spark, source).limit(1), inputs, outputs, markers)
    marks = {"marks_of_broken_run": F.lit(broken).cast("bigint"), "marks": F.lit(marked()).cast("bigint")}
    frames = {name: read_dataset(spark, target) for name, target in targets.items()}
    frames["dear"] = _kept(spark, frames["dear"], targets["dear"])
    return _sorted_out(spark, frames).withColumns(marks)


@query("required_fields")
def required_fields(spark, sf_dir):
    """A record whose type and user are required: a run with an event without a user fails, and commits nothing."""
    schema = T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("who", T.StructType([T.StructField("user_id", T.LongType(), False)]), False)])
    target = new_dataset(spark, "required", schema)
    user = F.when(F.col("event_type") != "error", F.col("user_id"))

    def strict(keep: str) -> Job:
        def of_users(events):
            return events.where(keep).select("event_id", F.struct(user.alias("user_id")).alias("who"))
        return Job("strict", of_users, {"events": None}, {"users": schema})

    refused = ""
    for keep in ("true", "event_type <> 'error'"):
        try:
            run_at(spark, strict(keep), SLOT_DAY, {"events": _plain_events(spark, sf_dir)}, {"users": target})
        except PySparkException as error:
            refused = "who.user_id is NULL" if "output users of job strict: who.user_id is NULL" in str(error) else str(error)
    return read_dataset(spark, target).select("event_id", "who.user_id").withColumn("refused", F.lit(refused))


def _plain_events(spark: SparkSession, sf_dir: str) -> View:
    source = new_dataset(spark, "events", EVENTS)
    write_view(events(spark, sf_dir), source)
    return source


@query("run_at_odd_users")
def run_at_odd_users(spark, sf_dir):
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "odd", EVENTS, DAY)
    markers = new_dataset(spark, "markers", None)
    run_at(spark, odd_users_job, SLOT_DAY, {"example_events": view_of(source, DAY_HOLES)},
           {"odd_users": view_of(target, DAY_HOLES)}, markers)
    marked = ready_marks(spark, markers, target.name)
    return read_dataset(spark, target).withColumn("nominal_time", slot_time(DAY)).join(marked, "nominal_time")


@query("backfill_odd_users")
def backfill_odd_users(spark, sf_dir):
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "odd", EVENTS, DAY)
    backfill(spark, odd_users_job, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
             {"odd_users": view_of(target, DAY_HOLES)}, clustered=True)
    return read_dataset(spark, target)


@query("backfill_report")
def backfill_report(spark, sf_dir):
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "report", REPORT, DAY)
    backfill(spark, slot_report_job, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
             {"report": view_of(target, DAY_HOLES)})
    return read_dataset(spark, target)


@query("backfill_again")
def backfill_again(spark, sf_dir):
    """All days written, then run again with a job that leaves early days empty: their old rows go."""
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "odd", EVENTS, DAY)
    for step in (odd_users_job, late_days_job):
        backfill(spark, step, _days(spark, source), {"example_events": view_of(source, DAY_HOLES)},
                 {"odd_users": view_of(target, DAY_HOLES)}, clustered=True)
    return read_dataset(spark, target)


@query("triggered_backfill")
def triggered_backfill(spark, sf_dir):
    """A schedule run for the slots that are due: days whose input is marked, less the one done before."""
    source = events_by_day(spark, sf_dir)
    target = new_dataset(spark, "odd", EVENTS, DAY)
    markers = new_dataset(spark, "markers", None)
    mark_views(_days(spark, source).select(F.lit(source.name).alias("view"), "nominal_time"), markers)
    schedule = Schedule(odd_users_job, "0 0 * * *", outputs={"odd_users": view_of(target, DAY_HOLES)},
                        inputs={"example_events": view_of(source, DAY_HOLES)})
    schedule.run_at(spark, SLOT_DAY, markers=markers)
    due = schedule.due(spark, markers, "2024-01-01T00:00Z", "2024-01-25T00:00Z")
    schedule.backfill(spark, due, markers=markers, clustered=True)
    return read_dataset(spark, target)


@query("ensure_dataset_evolves")
def dataset_evolved(spark, sf_dir):
    """Rows from before a column was added read as NULL in it."""
    name = work_path(spark, "evolved")
    table = f"slotwise_work.t{name.rpartition('-')[2]}"
    dataset = View("dataset:hive:" + table.replace(".", "/"), EVENTS)
    ensure_dataset(spark, dataset, location=name)
    write_view(events(spark, sf_dir), dataset)
    wider = View(dataset.uri, T.StructType([*EVENTS.fields, T.StructField("channel", T.StringType())]))
    ensure_dataset(spark, wider)
    errors = events(spark, sf_dir).where("event_type = 'error'")
    write_view(errors.withColumn("channel", F.concat(F.lit("from "), F.col("event_type"))), wider)
    # The table is external: its rows outlive the work table's name.
    spark.sql(f"DROP TABLE {table}")
    return read_dataset(spark, View("dataset:" + name, wider.schema))


GENERATIONS = [
    T.StructType([field("event_id", "long"), field("ts", "timestamp_ntz"), field("user_id", "integer"), field("value", "float"),
                  field("props", "string"), field("kind", T.StructType([field("name", "string")]))]),
    T.StructType([field("event_id", "long"), field("ts", "timestamp_ntz"), field("user_id", "long"),
                  field("value", "float"), field("props", "string"), field("channel", "string", "'web'"),
                  field("kind", T.StructType([field("name", "string"), field("level", "integer", "3", nullable=False)]))]),
    T.StructType([field("event_id", "long"), field("ts", "timestamp_ntz"), field("user_id", "long"),
                  field("value", "double"), field("channel", "string", "'web'"),
                  field("kind", T.StructType([field("level", "long", "3", nullable=False), field("name", "string"),
                                              field("rank", "integer")]))]),
]


def _of_generation(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Events as a writer of that schema would have them; every fourth channel is null."""
    made = {
        "channel": F.when(F.col("event_id") % 4 > 0, F.col("event_type")),
        "kind": F.when(F.col("event_type") != "error", F.struct(*(
            x.alias(n) for n, x in (("name", F.col("event_type")), ("level", F.length("event_type")), ("rank", F.lit(1)))
            if n in schema["kind"].dataType.fieldNames()))),
    }
    full = rows.withColumns({k: v for k, v in made.items() if k in schema.fieldNames()})
    return full.select(*(F.col(f.name).cast(f.dataType) if f.name != "kind" else F.when(F.col("kind").isNotNull(), F.struct(
        *(F.col(f"kind.{n.name}").cast(n.dataType).alias(n.name) for n in f.dataType))).alias("kind") for f in schema))


@query("schema_generations")
def schema_generations(spark, sf_dir):
    """Files of three schemas in one dataset, in a folder and in the catalog, read under the newest one."""
    folder = new_dataset(spark, "generations", None)
    path = work_path(spark, "generations")
    table = View(f"dataset:hive:slotwise_work/g{path.rpartition('-')[2]}", GENERATIONS[0])
    cuts = ["ts < '2024-01-11'", "ts >= '2024-01-11' and ts < '2024-01-21'", "ts >= '2024-01-21'"]
    for schema, cut in zip(GENERATIONS, cuts, strict=True):
        rows = _of_generation(events(spark, sf_dir).where(cut), schema)
        append(rows, View(folder.uri, schema))
        table = View(table.uri, schema)
        ensure_dataset(spark, table, path)
        write_view(rows, table)
    stores = {"folder": read_dataset(spark, View(folder.uri, GENERATIONS[-1])),
              "catalog": _kept(spark, read_dataset(spark, table), table)}
    shown = [df.select(F.lit(store).alias("store"), "event_id", "ts", "user_id", "value", "channel",
                       *(F.col(f"kind.{n}").alias(f"kind_{n}") for n in ("name", "level", "rank")))
             for store, df in stores.items()]
    return shown[0].unionByName(shown[1])


@query("save_nonempty")
def saved_nonempty(spark, sf_dir):
    target = new_dataset(spark, "saved", EVENTS)
    saved = [save_nonempty(rows, target) for rows in (
        events(spark, sf_dir), events(spark, sf_dir).where("event_type = 'no such type'"))]
    return read_dataset(spark, target).withColumns(
        {"first_saved": F.lit(int(saved[0])), "second_saved": F.lit(int(saved[1]))})


@query("map_columns_round_trip")
def map_columns(spark, sf_dir):
    """Map columns written and read back, shown as one row per entry."""
    pairs = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("settings", pairs)])
    target = new_dataset(spark, "maps", schema)
    write_view(events(spark, sf_dir).select("event_id", F.from_json("props", pairs).alias("settings")), target)
    return read_dataset(spark, target).select("event_id", F.explode("settings").alias("key", "value"))


# Topics and streams


def _topic(spark: SparkSession, label: str, schema: T.StructType = EVENTS) -> Topic:
    return Topic(work_path(spark, label), schema)


@query("topic_round_trip")
def topic_round_trip(spark, sf_dir):
    topic = _topic(spark, "topic")
    write_topic(events(spark, sf_dir), topic)
    return read_topic(spark, topic)


@job("keep-stream", inputs={"arriving": EVENTS}, outputs={"kept": EVENTS})
def topic_to_dataset_job(arriving):
    return arriving


@job("pass-on", inputs={"arriving": EVENTS}, outputs={"passed_on": EVENTS})
def topic_to_topic_job(arriving):
    return arriving


@query("stream_topic_to_dataset")
def stream_topic_to_dataset(spark, sf_dir):
    topic = _topic(spark, "topic")
    write_topic(events(spark, sf_dir), topic)
    target = new_dataset(spark, "streamed", EVENTS)
    for running in run_stream(spark, topic_to_dataset_job, {"arriving": topic}, {"kept": target},
                              work_path(spark, "checkpoint"), available_now=True):
        running.awaitTermination()
    return read_dataset(spark, target).select(*EVENTS.names)


def _streamed_by_day(spark: SparkSession, sf_dir: str) -> View:
    topic = _topic(spark, "topic")
    write_topic(events(spark, sf_dir), topic)
    target = new_dataset(spark, "streamed", EVENTS, DAY)
    for running in run_stream(spark, topic_to_dataset_job, {"arriving": topic}, {"kept": target},
                              work_path(spark, "checkpoint"), available_now=True, event_times={"kept": "ts"}):
        running.awaitTermination()
    return target


@query("stream_into_day_partitions")
def stream_into_day_partitions(spark, sf_dir):
    """A stream files its rows by the day they happened; a view of a day reads them."""
    return read_view(spark, view_of(_streamed_by_day(spark, sf_dir), "?year=2024&month=1&day=15"))


@job("sort-stream", inputs=["arriving"], outputs=["clicks", "dear", "users"])
def sort_stream_job(arriving):
    return emit(arriving, clicks=F.col("event_type") == "click", dear=F.col("value") > 50,
                users=(["event_id", "user_id", "ts"], None))


@query("stream_several_outputs")
def stream_several_outputs(spark, sf_dir):
    """A stream into two datasets and a topic, by one query that reads each message once."""
    topic, users = _topic(spark, "topic"), _topic(spark, "users", record(event_id="long", user_id="long", ts="timestamp_ntz"))
    write_topic(events(spark, sf_dir), topic)
    targets = {name: new_dataset(spark, name, EVENTS, DAY) for name in ("clicks", "dear")}
    for running in run_stream(spark, sort_stream_job, {"arriving": topic}, {**targets, "users": users},
                              work_path(spark, "checkpoint"), available_now=True, event_times=dict.fromkeys(targets, "ts")):
        running.awaitTermination()
    frames = {name: read_dataset(spark, target) for name, target in targets.items()}
    return _sorted_out(spark, {**frames, "users": with_time_parts(read_topic(spark, users), "ts", "day")})


@query("stream_closes_slots")
def stream_closes_slots(spark, sf_dir):
    """A stream marks the days it is past, then late rows come; what a schedule over its days finds due each time."""
    topic, target = _topic(spark, "topic"), new_dataset(spark, "streamed", EVENTS, DAY)
    odd, markers = new_dataset(spark, "odd", EVENTS, DAY), new_dataset(spark, "markers", None)
    schedule = Schedule(odd_users_job, "0 0 * * *", inputs={"example_events": view_of(target, DAY_HOLES)},
                        outputs={"odd_users": view_of(odd, DAY_HOLES)})
    checkpoint, found = work_path(spark, "checkpoint"), []
    late = "ts < '2024-01-08' and event_type = 'error'"
    steps = {"first": f"ts < '2024-01-15' and not ({late})", "late": late, "last": "ts >= '2024-01-15'"}
    for step, arriving in steps.items():
        write_topic(events(spark, sf_dir).where(arriving), topic)
        for running in run_stream(spark, topic_to_dataset_job, {"arriving": topic}, {"kept": target}, checkpoint,
                                  available_now=True, event_times={"kept": "ts"}, markers=markers, lateness="36 hours"):
            running.awaitTermination()
        due = schedule.due(spark, markers, "2023-12-31T12:00Z", "2024-03-01T00:00Z")
        rows = read_dataset(spark, target).select(slot_time(DAY).alias("nominal_time"), "event_id")
        report = due.join(rows, "nominal_time", "left").groupBy("nominal_time").agg(F.count("event_id").alias("n_events"))
        found.append(_written(spark, report.select(F.lit(step).alias("step"), "nominal_time", "n_events")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as they are now, whatever becomes of the tables they come from."""
    path = work_path(spark, "written")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("compact_stream")
def compacted_stream(spark, sf_dir):
    """Days that a stream wrote, written anew without its batch folders."""
    streamed = _streamed_by_day(spark, sf_dir)
    target = new_dataset(spark, "compacted", EVENTS, DAY)
    compact_stream(spark, _days(spark, streamed), view_of(streamed, DAY_HOLES), view_of(target, DAY_HOLES))
    return read_view(spark, view_of(target, "?year=2024&month=1&day=15"))


@query("per_batch_side_effect")
def per_batch_side_effect(spark, sf_dir):
    """What is done with each batch is the caller's: here a table of counts per batch, under the batch's number."""
    topic, counts = _topic(spark, "topic"), work_path(spark, "counts")
    write_topic(events(spark, sf_dir), topic)

    def count(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    for_each_batch(read_topic(spark, topic, streaming=True), count, work_path(spark, "checkpoint"),
                   available_now=True).awaitTermination()
    rows = spark.read.schema("event_type string, count bigint, batch int").parquet(counts)
    return rows.groupBy("event_type").agg(F.sum("count").alias("n_events"))


@query("stream_topic_to_topic")
def stream_topic_to_topic(spark, sf_dir):
    source, target = _topic(spark, "topic"), _topic(spark, "topic")
    write_topic(events(spark, sf_dir), source)
    for running in run_stream(spark, topic_to_topic_job, {"arriving": source}, {"passed_on": target},
                              work_path(spark, "checkpoint"), available_now=True):
        running.awaitTermination()
    return read_topic(spark, target)
