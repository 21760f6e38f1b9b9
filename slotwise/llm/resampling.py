"""Importance resampling toward a target distribution over hashed word features.

An untrained pre-tokeniser, a split by a pattern over ASCII-lowered text, returns words with their offsets; a window is
the pair of offsets at which a run of words begins and ends, and its feature the words between them, joined by single
spaces. Features fall into buckets by CRC-32. The buckets of all documents and those of the target's texts are two
histograms; a bucket's gain is the rounded log ratio of the two, smoothed by one, and a document's weight the sum of the
gains of its features. Adding Gumbel noise keyed by seed and id and taking the highest draws without replacement in
proportion to the exponentiated weights.

Every text is pre-tokenised once: its bucket numbers are written to the shared folder, two or four bytes for each feature,
and both the histogram and the weights are taken from there. Histograms have as many entries as there are buckets; no
other thing comes to the driver. Ranks are positions in a global order, dealt out by ranges.

Null and empty texts have no features, weight 0 and are not drawn, nor are those with fewer words than asked for. A null
id is hashed as `null` and comes last among equal scores; repeated rows are drawn one by one. Without documents or
without target texts the other side's counts are smoothed all the same. A text of any length is pre-tokenised whole,
in pieces cut between words. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from slotwise.llm.shared import checkpointed
from slotwise.llm.texts import map_batches, python_tasks
from slotwise.operators.positions import with_positions

BUCKETS = 10_000
MOST_WORDS = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

# Fixed value: what a word is made of, digits, letters and everything above ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_GAP = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]")
#: Characters that the pre-tokeniser is given at once; a word is never cut.
PIECE = 1 << 19
#: Features whose buckets a worker remembers.
REMEMBERED = 1 << 18


@lru_cache(1)
def _splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def words_with_offsets(text: str, piece: int = PIECE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Parts of the lowered text, cut between words, each with the offsets at which its words begin and end."""
    low = text.encode().lower().decode()
    at = 0
    while at < len(low):
        gap = _GAP.search(low, at + piece) if at + piece < len(low) else None
        end = gap.start() if gap else len(low)
        part = low[at:end]
        yield part, [offsets for _, offsets in _splitter().pre_tokenize_str(part)]
        at = end


class Buckets:
    """Bucket numbers of a text's features."""

    def __init__(self, count: int, most: int):
        self.count, self.most = count, most
        self.kind = np.dtype("<u2" if count <= 1 << 16 else "<u4")
        self.known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode()) % self.count
        return found

    def of(self, text: str | None, piece: int = PIECE) -> tuple[int, bytes]:
        """Number of words, and the buckets of all runs of 1 to `most` words, packed."""
        n, out, last = 0, [], []
        for part, offsets in words_with_offsets(text, piece) if text else ():
            words = [part[s:e] for s, e in offsets]
            n += len(words)
            found = [*map(self._bucket, words)]
            for size in range(2, self.most + 1):
                # Runs that began in the part before end here.
                line = last[len(last) - min(size - 1, len(last)):] + words
                found += [self._bucket(" ".join(line[i : i + size])) for i in range(len(line) - size + 1)]
            last = (last + words)[-(self.most - 1):] if self.most > 1 else []
            out.append(np.array(found, self.kind).tobytes())
        return n, b"".join(out)


@lru_cache(4)
def _buckets(count: int, most: int) -> Buckets:
    return Buckets(count, most)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
             most: int = MOST_WORDS) -> DataFrame:
    """key, n_words, n_features and the packed bucket numbers of every row."""
    def work(batch: dict[str, list]) -> dict[str, list]:
        of = _buckets(buckets, most)
        found = [of.of(t) for t in batch["text"]]
        width = of.kind.itemsize
        return {"key": batch["key"], "n_words": [n for n, _ in found],
                "n_features": [len(b) // width for _, b in found], "buckets": [b for _, b in found]}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work,
                       f"key {kind}, n_words bigint, n_features bigint, buckets binary")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; a task adds up its own, and sends a row per bucket."""
    kind = Buckets(buckets, 1).kind

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    python_tasks(rows)
    added = rows.select("buckets").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in added.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Of each bucket the smoothed log ratio of target to source, times `scale`, rounded down."""
    n, total, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([
        floor(scale * log((t + 1.0) * (total + n) / ((s + 1.0) * (wanted + n))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of :func:`features` with their weight, the sum of their features' gains, in place of the buckets."""
    kind = Buckets(len(gain), 1).kind

    @F.arrow_udf("bigint")
    def weigh(packed: pa.Array) -> pa.Array:
        return pa.array([int(gain[np.frombuffer(b.as_py(), kind)].sum()) for b in packed], pa.int64())

    python_tasks(rows)
    return rows.select("key", "n_words", "n_features", weigh("buckets").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most: int = MOST_WORDS,
             scale: int = 1000) -> DataFrame:
    """key, n_features, weight, score and rank of every document: rank 1 is drawn first, NULL is not drawn.

    Drawn are the highest scores, `percent` hundredths of the documents with at least `least_words` words; ties go to
    the smaller key. Features are runs of 1 to `most` words of `text`, which `target` has as well.
    """
    found = checkpointed(features(docs, key, text, buckets, most))
    wanted = features(target.select(F.lit(None).cast("bigint").alias("none"), text), "none", text, buckets, most)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets), scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = checkpointed(weights(found, gain).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    ranked = with_positions(scored.filter(able), [F.col("score").desc(), F.col("key").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("key", "n_features", "weight", "score", "rank")
