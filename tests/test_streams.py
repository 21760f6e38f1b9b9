"""Topics and streams: round trips, restarts, replayed batches, bad messages."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.transforms import odd_users, reconcile
from slotwise.plans.jobs import Job, run_stream
from slotwise.schemas import BATCH_PARTS, EVENT, TOPIC, with_batch_parts
from slotwise.sources.datasets import View, read_dataset
from slotwise.sources.generator import stream_events
from slotwise.sources.topics import Topic, read_topic, to_messages, write_topic
from slotwise.sources.datasets import ensure_dataset
from slotwise.streaming.sinks import stream_to_dataset, stream_to_topic, with_batch
from tests.test_datasets import database  # noqa: F401

SMALL = T.StructType().add("session_id", "string").add("user_id", "long")


def events(spark, n, session="1234"):
    return spark.range(n).select(F.lit(session).alias("session_id"), F.col("id").alias("user_id"))


def topic(folder, name, schema=SMALL):
    return Topic(folder(name).removeprefix("file:"), schema)


def finish(query):
    query.awaitTermination()
    return query


def test_round_trip(spark, folder):
    rows = spark.createDataFrame(
        [(1, "aé\"\n", None, None), (2, None, {"k": "v", "n": None}, 0.1), (None, "", {}, float("1e300"))],
        "id long, s string, m map<string,string>, d double",
    ).withColumn("t", F.lit("2024-01-01 00:00:00.123456").cast("timestamp_ntz")).withColumn(
        "z", F.lit("2024-01-01 00:00:00.123456").cast("timestamp"))
    t = topic(folder, "t", rows.schema)
    write_topic(rows, t)
    write_topic(rows, t)
    back = read_topic(spark, t)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert reconcile(rows.unionByName(rows), back).count() == 0


def test_messages_have_an_empty_key(spark, folder):
    t = topic(folder, "t")
    write_topic(events(spark, 1).withColumn("extra", F.lit(1)), t)
    raw = spark.read.schema(TOPIC).option("recursiveFileLookup", "true").parquet(t.name).first()
    assert bytes(raw.key) == b"" and bytes(raw.value) == b'{"session_id":"1234","user_id":0}'


def test_a_bad_message_fails_the_read(spark, folder):
    t = topic(folder, "t")
    write_topic(events(spark, 1), t)
    bad = spark.range(1).select(F.lit(b"").alias("key"), F.lit(b"{not json").alias("value"),
                                F.current_timestamp().alias("timestamp"))
    bad.write.mode("append").parquet(t.name)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_topic(spark, t).collect()


def test_topics_need_a_name_and_a_schema(spark, folder):
    with pytest.raises(ValueError):
        Topic("", SMALL)
    with pytest.raises(TypeError):
        Topic("events", None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_topic(spark, topic(folder, "none")).collect()


def test_stream_to_dataset_restarts_where_it_stopped(spark, folder, tmp_path):
    t, out = topic(folder, "t"), View("dataset:" + folder("out"), SMALL)
    write_topic(events(spark, 10), t)
    for added, wanted in ((0, 10), (0, 10), (5, 15)):
        if added:
            write_topic(events(spark, added, "new"), t)
        finish(stream_to_dataset(read_topic(spark, t, streaming=True), out, f"{tmp_path}/cp", available_now=True))
        assert read_dataset(spark, out).count() == wanted
    sent = events(spark, 10).unionByName(events(spark, 5, "new"))
    assert reconcile(sent, read_dataset(spark, out).select(*SMALL.names)).count() == 0


def test_replayed_batch_is_kept_once(spark, folder, tmp_path):
    """The commit of the last batch is lost, as after a crash: the batch runs again over its own folder."""
    t, out, copy = topic(folder, "t"), View("dataset:" + folder("out"), SMALL), topic(folder, "copy")
    write_topic(events(spark, 10), t)

    def run():
        stream = read_topic(spark, t, streaming=True)
        finish(stream_to_dataset(stream, out, f"{tmp_path}/cp-dataset", available_now=True))
        finish(stream_to_topic(stream, copy, f"{tmp_path}/cp-topic", available_now=True))

    run()
    for name in ("cp-dataset", "cp-topic"):
        for entry in os.listdir(f"{tmp_path}/{name}/commits"):
            os.remove(f"{tmp_path}/{name}/commits/{entry}")
    run()
    assert read_dataset(spark, out).count() == 10
    assert read_topic(spark, copy).count() == 10


def test_a_new_checkpoint_adds_to_the_dataset(spark, folder, tmp_path):
    """Batch 0 of a stream begun anew does not replace batch 0 of the one before."""
    t, out = topic(folder, "t"), View("dataset:" + folder("out"), SMALL)
    write_topic(events(spark, 10), t)
    for name in ("first", "second"):
        finish(stream_to_dataset(read_topic(spark, t, streaming=True), out, f"{tmp_path}/{name}", available_now=True))
    assert read_dataset(spark, out).count() == 20


def test_empty_batches_write_nothing(spark, folder, tmp_path):
    t, out = topic(folder, "t"), View("dataset:" + folder("out"), SMALL)
    write_topic(events(spark, 10), t)
    nobody = read_topic(spark, t, streaming=True).where("user_id < 0")
    finish(stream_to_dataset(nobody, out, f"{tmp_path}/cp", available_now=True))
    assert not [name for name in os.listdir(folder("out").removeprefix("file:")) if not name.startswith(("_", "."))]
    with pytest.raises(ValueError, match="streaming query"):
        with_batch(events(spark, 1), 0)


def test_stream_to_catalog_table(spark, folder, tmp_path, database):  # noqa: F811
    t = topic(folder, "t")
    write_topic(events(spark, 10), t)
    out = View(f"dataset:hive:{database}/streamed", with_batch_parts(SMALL), BATCH_PARTS)
    ensure_dataset(spark, out)
    for added in (0, 5):
        if added:
            write_topic(events(spark, added, "new"), t)
        finish(stream_to_dataset(read_topic(spark, t, streaming=True), out, f"{tmp_path}/cp", available_now=True))
    sent = events(spark, 10).unionByName(events(spark, 5, "new"))
    assert reconcile(sent, read_dataset(spark, out).select(*SMALL.names)).count() == 0
    assert read_dataset(spark, out).select("batch_id").distinct().count() == 2


def test_streaming_job_to_topic_and_dataset(spark, folder, tmp_path):
    t, target, out = topic(folder, "t"), topic(folder, "target"), View("dataset:" + folder("out"), SMALL)
    write_topic(events(spark, 10), t)
    split = Job("split", lambda stream: {"all": stream, "odd": odd_users(stream)}, {"stream": SMALL},
                {"all": SMALL, "odd": SMALL})
    for query in run_stream(spark, split, {"stream": t}, {"all": target, "odd": out}, f"{tmp_path}/cp", available_now=True):
        finish(query)
    assert reconcile(events(spark, 10), read_topic(spark, target)).count() == 0
    assert sorted(r.user_id for r in read_dataset(spark, out).collect()) == [1, 3, 5, 7, 9]
    # The target can be read as a stream again.
    again = View("dataset:" + folder("again"), SMALL)
    finish(stream_to_dataset(read_topic(spark, target, streaming=True), again, f"{tmp_path}/cp2", available_now=True))
    assert read_dataset(spark, again).count() == 10
    with pytest.raises(TypeError, match="reads topics only"):
        run_stream(spark, split, {"stream": out}, {"all": target, "odd": out}, f"{tmp_path}/cp3")
    with pytest.raises(ValueError, match="needs output odd"):
        run_stream(spark, split, {"stream": t}, {"all": target}, f"{tmp_path}/cp3")


def test_continuous_stream_of_generated_events(spark, folder, tmp_path):
    out = View("dataset:" + folder("out"), EVENT)
    query = stream_to_dataset(stream_events(spark), out, f"{tmp_path}/cp")
    try:
        deadline = time.time() + 60
        while len([p for p in query.recentProgress if p["numInputRows"]]) < 3 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = read_dataset(spark, out).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.collect_set("session_id").alias("s"), F.sort_array(F.collect_list("user_id")).alias("u"))
    batches = rows.collect()
    assert len(batches) >= 3
    for batch in batches:
        assert (batch.n, batch.s, batch.u) == (10, ["1234"], list(range(10)))


def test_broker_topics_use_the_same_messages(spark):
    """The connector is not installed here, so only what would be sent, and the attempt, can be checked."""
    t = Topic("example_events", SMALL, format="kafka", options={"kafka.bootstrap.servers": "example:9092"})
    assert to_messages(events(spark, 1), t).columns == ["key", "value"]
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, t)


def test_avro_messages_need_the_connector(spark):
    t = Topic("events", SMALL, avro_schema='{"type":"record","name":"e","fields":[]}')
    with pytest.raises(Exception, match="(?i)avro"):
        to_messages(events(spark, 1), t).collect()
