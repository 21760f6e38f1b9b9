"""Topics: streams of binary records, kept by a broker (``kafka``) or as Parquet files in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.sinks import overwrite_folders
from slotwise.schemas import BATCH_PARTS, TOPIC

# Times keep their microseconds in both directions; a record that cannot be read fails the query.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


@dataclass(frozen=True)
class Topic:
    """A topic and the schema of its records.

    ``name`` is the topic's name at a ``kafka`` broker, or its folder when ``format`` is ``parquet``. ``options``
    go to the source or sink unchanged (``kafka.bootstrap.servers``, ``maxOffsetsPerTrigger``,
    ``maxFilesPerTrigger`` ...). Records are JSON unless ``avro_schema`` is given.
    """

    name: str
    schema: T.StructType
    format: str = "parquet"
    avro_schema: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a topic needs a name")
        if not isinstance(self.schema, T.StructType):
            raise TypeError("a topic needs the schema of its records")


def encode(record: Column, topic: Topic) -> Column:
    """A struct as the bytes of a message."""
    if topic.avro_schema is not None:
        from pyspark.sql.avro.functions import to_avro
        return to_avro(record, topic.avro_schema)
    return F.encode(F.to_json(record, JSON_OPTIONS), "utf-8")


def decode(value: Column, topic: Topic) -> Column:
    """The bytes of a message as a struct."""
    if topic.avro_schema is not None:
        from pyspark.sql.avro.functions import from_avro
        return from_avro(value, topic.avro_schema, {"mode": "FAILFAST"})
    return F.from_json(value.cast("string"), topic.schema, {**JSON_OPTIONS, "mode": "FAILFAST"})


def to_messages(df: DataFrame, topic: Topic) -> DataFrame:
    """Messages with an empty key; the columns are those of the topic's schema."""
    record = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in topic.schema))
    return df.select(F.lit(b"").alias("key"), encode(record, topic).alias("value"))


def from_messages(messages: DataFrame, topic: Topic) -> DataFrame:
    """The records of messages; the key is dropped."""
    return messages.select(decode(F.col("value"), topic).alias("record")).select("record.*")


def read_topic(spark: SparkSession, topic: Topic, streaming: bool = False) -> DataFrame:
    """The records of a topic from its first message on, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    if topic.format == "kafka":
        messages = (reader.format("kafka").option("subscribe", topic.name)
                    .option("startingOffsets", "earliest").options(**topic.options).load())
    else:
        # Batches of a stream lie in folders of their own below the topic's.
        messages = (reader.schema(TOPIC).option("recursiveFileLookup", "true")
                    .options(**topic.options).parquet(topic.name))
    return from_messages(messages, topic)


def write_topic(df: DataFrame, topic: Topic) -> None:
    """Append the rows of a table to a topic."""
    messages = to_messages(df, topic)
    if topic.format == "kafka":
        messages.write.format("kafka").option("topic", topic.name).options(**topic.options).save()
    else:
        # A folder per write: writers of one topic do not meet, and readers look below it.
        send_to_folder(messages.withColumns(
            {"query_id": F.lit("table-" + uuid.uuid4().hex), "batch_id": F.lit(0)}), topic)


def send_to_folder(messages: DataFrame, topic: Topic) -> None:
    stamped = messages.withColumn("timestamp", F.current_timestamp())
    overwrite_folders(stamped, topic.name, BATCH_PARTS)
