"""A training corpus from raw documents, stage by stage; each stage calls one operator of slotwise.llm.

Every stage is written as Parquet to the shared folder and read from there by the next one, so a lost executor costs a
task, not the run. Null ids, texts and labels, repeated rows, empty tables and further columns are fine in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.compression_langid import identify, learn
from slotwise.llm.decontamination import find_items
from slotwise.llm.merge_dropout import encode
from slotwise.llm.pii import pseudonymise
from slotwise.llm.shared import shared_folder
from slotwise.llm.simhash_trie import verified_copies
from slotwise.llm.texts import all_columns, free_name
from slotwise.session import delete_path

#: Pseudonyms of one key link with each other only; a production run brings its own.
PII_KEY = "an example key, replace it"
#: Near copies share four fifths of their five-word shingles; each link is verified by that.
SHINGLE, SIMILARITY = 5, 0.8
#: What proposes links besides bands of shingles: if about one word in fifty differs, SimHash over distinct words puts
#: copies about 4 of 64 bits apart; under five-word shingles it would be 10. Four hashes find what one misses.
WORDS, BITS, SEEDS = 1, 4, (42, 43, 44, 45)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; learned from the documents' own labels."""
    name = free_name(docs, "_found")
    found = identify(docs, learn(docs), into=name)
    return found.filter(F.col(name).accepted).select(all_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, the first row if ids are equal."""
    name = free_name(docs, "_row")
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(name).alias("row"))
    found = verified_copies(numbered.select(key.alias("key"), "text"), "key", SHINGLE, SIMILARITY, WORDS, BITS, SEEDS)
    copies = found.filter("key.row <> component.row").select(F.col("key.row").alias(name))
    return numbered.join(copies, name, "left_anti").select(all_columns(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    name = free_name(docs, "_found")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=name)
    return found.filter(F.size(F.col(name).items) == 0).select(all_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars counts the new text."""
    found = pseudonymise(docs.select(F.struct(*all_columns(docs)).alias("doc"), "text"), PII_KEY)
    return found.withColumn("doc", F.col("doc").withField("text", F.col("text"))
                            .withField("n_chars", F.length("text").cast("long"))).select("doc.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their text under merge-dropout, and how many these are."""
    return encode(docs, into="ids").withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Compression, fingerprints and merges have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written, and read again by the next stage, after which it goes."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return docs
