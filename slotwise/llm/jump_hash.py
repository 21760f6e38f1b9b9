"""Jump consistent hashing: stable keys to shards without a ring table, and gapless slots within each shard.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014). One more shard takes rows only into
itself, about one in (shards + 1). Everything is a column expression: no Python runs on executors.

Nulls: a null key goes where key 0 goes, a null text has no bytes. Equal rows are counted before the shuffle, so a
third of all rows being copies of one row costs no task more than another; they get a slot each. An empty table gives
an empty result. Only the columns named are read; others, whatever their names, play no part.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value of the published generator, 2862933555777941757, in parts of 16 bits, lowest first.
MULTIPLIER = (0xB0FD, 0x87B0, 0x2EE6, 0x27BB)
LOW_32 = 0xFFFFFFFF
ROWS_PER_BUCKET = 100_000
COPIES_AT_ONCE = 4096


def _times_multiplier(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64 in halves of 32 bits; no step exceeds 50 bits, so ANSI mode accepts it."""
    c0, c1, c2, c3 = (F.lit(c).cast("long") for c in MULTIPLIER)
    upper = lo * c1
    low = lo * c0 + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (
        F.shiftright(low, 32) + F.shiftright(upper, 16)
        + lo * c2 + F.shiftleft((lo * c3).bitwiseAND(F.lit(0xFFFF)), 16)
        + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return high.bitwiseAND(F.lit(LOW_32)), low.bitwiseAND(F.lit(LOW_32))


def jump_shards(key: Column, shards: int) -> Column:
    """A struct of `shard` among `shards` and `grown_shard` among one more, from a BIGINT key.

    Both come from one walk: a key's jumps for n shards are those for n + 1 that stay below n. The walk takes at most
    n + 1 jumps, about ln n as a rule; steps after the last jump do nothing.
    """
    key = F.coalesce(key.cast("long"), F.lit(0))
    number = lambda x: F.lit(x).cast("long")

    def step(state: Column, _: Column) -> Column:
        hi, lo = _times_multiplier(state.hi, state.lo)
        jump = (state.at + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1))
        return F.when(state.at > shards, state).otherwise(F.struct(
            F.when(state.at < shards, state.at).otherwise(state.shard).alias("shard"),
            state.at.alias("grown"), jump.cast("long").alias("at"), hi.alias("hi"), lo.alias("lo"),
        ))

    start = F.struct(
        number(-1).alias("shard"), number(-1).alias("grown"), number(0).alias("at"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW_32)).alias("lo"),
    )
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    walk = F.transform(F.array(last), lambda s: F.struct(
        s.shard.cast("int").alias("shard"), s.grown.cast("int").alias("grown_shard")))
    return walk[0]


def shard_documents(docs: DataFrame, shards: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row.

    Slots run from 0 without a gap within each shard. A shard's rows are numbered in buckets of about
    `rows_per_bucket`, whose number follows the table, and a bucket starts where the ones before it end; no task
    holds a whole shard. Within a bucket rows are ordered by id, size and checksum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    buckets = max(1, ceil(docs.select("doc_id").count() / (shards * rows_per_bucket)))
    kinds = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("to", jump_shards(F.col("doc_id"), shards))
        # Never null, and said so: else the join below would filter on the walk before the rows are counted.
        .select("doc_id", "size", "text_crc32", "copies", F.coalesce("to.shard", F.lit(0)).alias("shard"), "to.grown_shard",
                F.coalesce(F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)), F.lit(0)).alias("bucket"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kinds.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = (Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("start") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    numbered = (
        kinds.join(starts, ["shard", "bucket"])
        .select("*", first.alias("first"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("part"))
        # Copies of one row leave the task that counted them.
        .repartition("doc_id", "size", "text_crc32", "part")
        .select("*", F.explode(F.sequence("part", F.least(F.col("copies"), F.col("part") + COPIES_AT_ONCE) - 1)).alias("nth"))
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
