"""Benchmark decontamination by a prefix-filtered set join with exact containment of item-sized windows.

A window is `size` consecutive words of a benchmark item, or the whole item if it has fewer. A document is hit where
all words of a window stand in it in order. Each window is a set of shingles (three words, or the whole window if it
is shorter); containing the window means containing all of them, so the prefix that is necessary at containment 1 is
a single shingle. Shingles are ordered by rarity in the documents, counted over all of them, and each window is filed
under its rarest. A document's shingles are looked up in that file; a candidate's place in the document must leave
room for the window before and after it (positional and length bound), and its words are then compared one by one.

The benchmark is a stated set of queries: it is read in blocks of `BLOCK_CHARS`, each of which is indexed and sent to
the workers, so what is broadcast has a bound and larger benchmarks take more turns, not more memory. Documents stay
in the task that reads them: no shuffle but that of the shingle counts, which are as many as the block's shingles. A
task takes `CHUNK_CHARS` of documents at once, and the text that goes beyond, however many a batch holds.

Null and empty texts have no words, and items without words no windows. Items of one id count once; a null id counts
as the id `null`. Repeated rows are judged each for itself. Columns besides the text pass through,
but for one named as the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, StringType, StructField, StructType,
)

from slotwise.llm.shared import checkpointed
from slotwise.llm.texts import chunks, give_back, map_batches, python_tasks

WINDOW = 10
SHINGLE = 3
BLOCK_CHARS = 4_000_000
#: Text that a task takes at once; its words are numbers in arrays of the same length.
CHUNK_CHARS = 1_000_000

#: A-Z become a-z; digits, a-z and every byte above 7F are parts of words; all else separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Index:
    """Windows of a block of benchmark items, by shingle."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            length = min(size, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + length]), set()).add(name)
        self.windows = list(owners)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        # All windows in one array, each from its first word on.
        self.firsts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1].astype(np.int64)
        self.flat = np.fromiter((i for w in self.windows for i in w), np.int64, int(self.lengths.sum()))
        shingles = [(self._key(w[i : i + min(SHINGLE, len(w))])) for w in self.windows
                    for i in range(len(w) - min(SHINGLE, len(w)) + 1)]
        self.shingles = np.unique(np.array(shingles, np.uint64))
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.prefix = np.zeros(0, np.uint64)

    @staticmethod
    def _key(ids: tuple[int, ...]) -> int:
        """A number of a shingle; two shingles may share one, since words are compared afterwards."""
        key = len(ids)
        for i in ids:
            key = (key * 0x9E3779B97F4A7C15 + i + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def order(self, counts: dict[int, int]) -> Index:
        """Files each window under its rarest shingle, the first one if several are as rare."""
        keys, offsets = [], []
        for w in self.windows:
            n = min(SHINGLE, len(w))
            named = [(counts.get(k := self._key(w[i : i + n]), 0), i, k) for i in range(len(w) - n + 1)]
            _, offset, key = min(named)
            keys.append(key), offsets.append(offset)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.prefix, self.prefix_first = np.unique(np.array(keys, np.uint64)[order], return_index=True)
        self.prefix_end = np.append(self.prefix_first[1:], len(order))
        self.filed, self.offsets = order, np.array(offsets, np.int64)[order]
        return self

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, -1 for other words and between texts; where each text starts, and the end."""
        parts, starts, at = [], [0], 0
        get = self.vocabulary.get
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            parts.append(np.full(1, -1))
            at += len(words) + 1
            starts.append(at)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts, np.int64)

    def found(self, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles in the text whose number is `wanted` (sorted), and which it is."""
        places, which = [], []
        for n in self.sizes:
            if len(ids) < n or not len(wanted):
                continue
            known = ids >= 0
            whole = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                whole &= known[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(whole)
            key = np.full(len(at), n, np.uint64)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
            slot = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = wanted[slot] == key
            places.append(at[hit]), which.append(slot[hit])
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(which)) if places else (none, none)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each of the shingles stands in the texts."""
        total = np.zeros(len(self.shingles), np.int64)
        for part in chunks(texts, CHUNK_CHARS):
            total += np.bincount(self.found(self.ids(texts[part])[0], self.shingles)[1], minlength=len(total))
        return total

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which windows stand in the text, and which windows."""
        places, which = self.found(ids, self.prefix)
        if not len(places):
            return places, which
        first, count = self.prefix_first[which], (self.prefix_end - self.prefix_first)[which]
        filed = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        window = self.filed[filed]
        start = np.repeat(places, count) - self.offsets[filed]
        length = self.lengths[window]
        fits = (start >= 0) & (start + length <= len(ids))
        start, window, length = start[fits], window[fits], length[fits]
        same = np.ones(len(start), bool)
        for k in range(int(length.max(initial=0))):
            look = np.flatnonzero(same & (length > k))
            same[look] = ids[start[look] + k] == self.flat[self.firsts[window[look]] + k]
        return start[same], window[same]


FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(IntegerType())),
    StructField("items", ArrayType(StringType())),
])


def mark(texts: list[str | None], before: list[tuple[np.ndarray, list[str]]] | None, index: Index) -> pd.DataFrame:
    """Of each text: words, hit spans (starts and ends by turns, merged) and items; `before` are those found so far."""
    parts = [*chunks(texts, CHUNK_CHARS)] or [slice(0)]
    found = pd.concat([_marked(texts[part], before and before[part], index) for part in parts], ignore_index=True)
    give_back()
    return found


def _marked(texts: list[str | None], before: list[tuple[np.ndarray, list[str]]] | None, index: Index) -> pd.DataFrame:
    ids, starts = index.ids(texts)
    place, window = index.occurrences(ids)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + index.lengths[window], -1)
    items: list[set[str]] = [set() for _ in texts]
    owner = np.searchsorted(starts, place, side="right") - 1
    for doc, w in set(zip(owner.tolist(), window.tolist(), strict=True)):
        items[doc].update(index.owners[w])
    for doc, (spans, names) in enumerate(before or []):
        items[doc].update(names)
        np.add.at(cover, spans[0::2] + starts[doc], 1)
        np.add.at(cover, spans[1::2] + starts[doc], -1)
    hit = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8)))
    edges = np.flatnonzero(np.diff(hit, append=0))
    of = np.searchsorted(starts, edges, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return pd.DataFrame({
        "n_words": np.diff(starts) - 1,
        "spans": [(edges[cuts[d] : cuts[d + 1]] - starts[d]).astype(np.int32) for d in range(len(texts))],
        "items": [sorted(x) for x in items],
    })


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items with their words, as many at a time as `chars` allow, one at least."""
    block, held = [], 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    for row in named.filter("text is not null").toLocalIterator():
        if block and held + len(row.text) > chars:
            yield block
            block, held = [], 0
        block.append((row.name, words_of(row.text)))
        held += len(row.text)
    if block:
        yield block


def shingle_counts(docs: DataFrame, index: Index, text: str = "text") -> dict[int, int]:
    """How often each of the index's shingles stands in all documents; as many numbers as the index has shingles."""
    fixed = python_tasks(docs).broadcast(index)

    def count(batch: dict[str, list]) -> dict[str, list]:
        times = fixed.value.counts(batch[text])
        shingle = np.flatnonzero(times)
        return {"shingle": shingle, "times": times[shingle]}

    counts = map_batches(docs.select(text), count, "shingle bigint, times bigint")
    rows = counts.groupBy("shingle").agg(F.sum("times").alias("times")).collect()
    return {int(index.shingles[r.shingle]): r.times for r in rows}


def find_items(docs: DataFrame, benchmark: DataFrame, into: str = "found", text: str = "text",
               size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with a struct of n_words, spans and items, where spans are word places hit, start and end by turns.

    Of the benchmark, the driver holds one block of `block_chars` at a time. Its turn over the documents is written to
    the shared folder before the next block is read; the last, mostly the only one, is left to the caller.
    """
    context = python_tasks(docs)
    out, fixed = docs, None
    done: Column | None = None
    items = blocks(benchmark, block_chars)
    block = next(items, [])
    while block is not None:
        if fixed is not None:
            out = checkpointed(out)
            fixed.unpersist()
        index = Index(block, size)
        fixed = context.broadcast(index.order(shingle_counts(docs, index, text) if len(index.windows) else {}))
        out = out.withColumn(into, _marker(fixed)(text, *([] if done is None else [done])))
        done = F.col(into)
        block = next(items, None)
    return out


def _marker(fixed):
    @F.pandas_udf(FOUND)
    def first(texts: pd.Series) -> pd.DataFrame:
        return mark(texts.tolist(), None, fixed.value)

    @F.pandas_udf(FOUND)
    def further(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        before = [(np.asarray(s), list(i)) for s, i in zip(found["spans"], found["items"], strict=True)]
        return mark(texts.tolist(), before, fixed.value)

    return lambda text, *found: further(text, *found) if found else first(text)


def hit_words(spans: Column) -> Column:
    """Words inside spans."""
    signs = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda total, x: total + x)


def items_digest(items: Column) -> Column:
    """SHA-256 of item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
