"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts c of words and word pairs are quantised to levels q = 1 + floor(log_b c), and each n-gram is stored with every
level from 1 to q. A count is read back by probing level after level until one misses. The filter is broadcast; pair
probabilities are smoothed toward the word's own by a Dirichlet prior, p(w|v) = (c(vw) + mu p(w)) / (c(v) + mu), with
p(w) = (c(w) + 1) / (N + V + 1).

Growth and bounds. The filter takes `BITS_PER_ENTRY` bits per stored level, so it grows with the training text, at one
error rate throughout. It is made of pages by the upper bits of the n-gram's hash; a page is filled by one group of
about `NGRAMS_PER_PAGE` n-grams, so the number of pages follows the text. What is broadcast at once is a block of pages,
`BLOCK_BYTES` of them (or one page, if that is larger). Documents are scored in one turn per block: a turn looks up what lies in its
block and keeps the levels found, one byte for each word and pair, for the next; the last one computes the scores. Text
and levels lie compressed in the shared folder meanwhile; a turn's go once the next one's are written, so there are two
copies at most, however many turns there are, and none at the end. The block size changes no score. All words' counts come from the filter, frequent or not.

Exact word counts are needed for the base score only. They are never broadcast as a whole: the most frequent words,
`MAX_HOT_WORDS` at most, are, and the others meet their documents in a join, into which each document sends only its
rare words. So no frequent word is a join key at all; how many are broadcast changes no result.

Words stand for themselves by 64-bit hashes, word pairs by 52 bits of a hash. Null text is empty text: one token, the
end. Words of any length, repeated rows and an empty training set are fine; without training N and V are 0. Rows keep
their own numbers, so equal ids do not mix. Only the id, text and split columns are read.

The input must give the same rows on each reading, as tables do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count
from math import ceil, log, log2, log10

import numpy as np
import pandas as pd
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.shared import checkpointed
from slotwise.llm.texts import chunks, map_batches, python_tasks
from slotwise.session import delete_path, work_path

BASE = 1.5
MU = 50.0
BITS_PER_ENTRY = 8
PROBES = 4
BLOCK_BYTES = 1 << 26
MIN_PAGE_BITS = 64
LEAST_PAGES = 1 << 10
NGRAMS_PER_PAGE = 4_000_000
MAX_HOT_WORDS = 1 << 20
#: Text that a task takes at once.
CHUNK_CHARS = 3_000_000

#: Words have no white space, so these are no words.
END, START = (xxhash.xxh64_intdigest(x) for x in (b"\n", b" "))
_KEY_BITS = 52
#: Levels of counts up to 10**21; one byte holds them.
MAX_LEVEL = 120


def levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, 1)) / log(BASE) + 1e-9).astype(np.int64)


def level_means(most: int = MAX_LEVEL) -> np.ndarray:
    """The mean of the whole numbers of each level; 0 for level 0."""
    edge = [ceil(BASE**j - 1e-9) for j in range(most + 1)]
    return np.array([0.0] + [(edge[j] + edge[j + 1] - 1) / 2 for j in range(most)])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - _KEY_BITS)


def word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - _KEY_BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def probes(keys: np.ndarray, level: np.ndarray | int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a key at a level within its page, one after another."""
    h = mixed(keys + np.asarray(level, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    step = mixed(h) | np.uint64(1)
    for _ in range(PROBES):
        yield h % sizes
        h = h + step


class Filter:
    """Some pages of bits, `first` and those behind it; the upper bits of a key name its page."""

    def __init__(self, sizes: list[int], pages: Iterable[tuple[int, bytes]], page_bits: int, first: int = 0):
        """`sizes` in bytes of pages, and pages by number, which are put in place one after another; others are empty."""
        self.shift, self.first = np.uint64(_KEY_BITS - page_bits), first
        size = np.array(sizes, np.int64)
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        self.bits = np.zeros(starts[-1], np.uint8)
        for page, bits in pages:
            self.bits[starts[page - first] : starts[page - first + 1]] = np.frombuffer(bits, np.uint8)
        self.sizes, self.starts = size.astype(np.uint64) * np.uint64(8), starts[:-1].astype(np.uint64) * np.uint64(8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing, 0 for n-grams that are not stored or lie on pages of other blocks."""
        level = np.zeros(len(keys), np.uint8)
        page = (keys >> self.shift).astype(np.int64) - self.first
        active = np.flatnonzero((page >= 0) & (page < len(self.sizes)))
        start, size = (np.zeros(len(keys), np.uint64) for _ in range(2))
        start[active], size[active] = self.starts[page[active]], self.sizes[page[active]]
        for j in range(1, MAX_LEVEL + 1):
            there = np.ones(len(active), bool)
            for place in probes(keys[active], j, size[active]):
                at = start[active] + place
                there &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            active = active[there]
            if not len(active):
                break
            level[active] = j
        return level


def fill(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A page that holds each key at all levels of its count."""
    level = levels(counts)
    size = max(MIN_PAGE_BITS, int(level.sum()) * BITS_PER_ENTRY) // 8 * 8
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        keys, level = keys[level >= j], level[level >= j]
        for place in probes(keys, j, np.uint64(size)):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Chunk:
    """Token sequences of some texts: places of words in `hashes`, with a start and an end for each text."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[bytes, int] = {}
        parts, sizes, at = [], [], 2
        for text in texts:
            words = text.encode().lower().split() if text else []
            parts += [_START, np.fromiter(map(numbers.setdefault, words, count(at)), np.int64, len(words)), _END]
            sizes.append(len(words) + 2)
            at += len(words)
        self.tokens = np.concatenate(parts)
        self.hashes = np.zeros(at, np.uint64)
        self.hashes[0], self.hashes[1] = START, END
        self.hashes[np.fromiter(numbers.values(), np.int64, len(numbers))] = np.fromiter(
            map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.n_tokens = np.array(sizes) - 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, words and texts of all tokens; a start is no token."""
        word = self.tokens[1:] != 0
        return self.tokens[:-1][word], self.tokens[1:][word], self.text[1:][word]


_START, _END = np.zeros(1, np.int64), np.ones(1, np.int64)


def word_counts(training: DataFrame) -> DataFrame:
    """h (hash of a word) and c (its count) of all words and the end."""
    def work(batch: dict[str, list]) -> dict[str, list]:
        hashes, counts = [], []
        for part in chunks(batch["text"], CHUNK_CHARS):
            chunk = Chunk(batch["text"][part])
            n = np.bincount(chunk.tokens, minlength=len(chunk.hashes))
            n[0] = 0
            hashes.append(chunk.hashes[n > 0]), counts.append(n[n > 0])
        return {"h": np.concatenate(hashes).view(np.int64) if hashes else [],
                "c": np.concatenate(counts) if counts else []}

    counted = map_batches(training.select("text"), work, "h bigint, c bigint")
    return counted.groupBy("h").agg(F.sum("c").alias("c"))


def _packed(keys: np.ndarray, counts: np.ndarray, page_bits: int) -> dict[str, list]:
    """Keys and counts as one row per page, seven bytes of key and four of count for each n-gram.

    First all keys' lowest bytes, then all second ones and so on: the upper ones are alike within a page, and compress.
    """
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    page = (keys >> np.uint64(_KEY_BITS - page_bits)).astype(np.int64)
    names, firsts = np.unique(page, return_index=True)
    ends = np.append(firsts[1:], len(keys))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (_KEY_BITS + 7) // 8]
    return {"page": names, "keys": [low[a:b].T.tobytes() for a, b in zip(firsts, ends)],
            "counts": [counts[a:b].astype("<u4").tobytes() for a, b in zip(firsts, ends)]}


def filter_pages(training: DataFrame, words: DataFrame, n_tokens: int) -> tuple[DataFrame, int]:
    """Pages of the filter of all words and word pairs of the training texts, a table; and how many bits name a page."""
    page_bits = max(int(log2(LEAST_PAGES)), ceil(log2(max(1, n_tokens / NGRAMS_PER_PAGE))))
    schema = "page int, keys binary, counts binary"

    def pairs(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"page": [], "keys": [], "counts": []}
        for part in chunks(batch["text"], CHUNK_CHARS):
            chunk = Chunk(batch["text"][part])
            context, word, _ = chunk.pairs()
            pair, n = np.unique(context * len(chunk.hashes) + word, return_counts=True)
            keys = pair_keys(chunk.hashes[pair // len(chunk.hashes)], chunk.hashes[pair % len(chunk.hashes)])
            for name, values in _packed(keys, n, page_bits).items():
                out[name].extend(values)
        return out

    def singles(batch: dict[str, list]) -> dict[str, list]:
        keys = word_keys(np.array(batch["h"], np.int64).view(np.uint64))
        return _packed(keys, np.minimum(np.array(batch["c"], np.int64), 0xFFFFFFFF), page_bits)

    width = (_KEY_BITS + 7) // 8

    def page(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1) for x in group["keys"]], axis=1)
        keys = np.zeros((raw.shape[1], 8), np.uint8)
        keys[:, :width] = raw.T
        counts = np.frombuffer(b"".join(group["counts"]), "<u4").astype(np.int64)
        keys, place = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(keys))
        return pd.DataFrame({"page": group["page"].iloc[:1], "bits": [fill(keys, total)]})

    rows = map_batches(training.select("text"), pairs, schema).unionByName(map_batches(words, singles, schema))
    return checkpointed(rows.groupBy("page").applyInPandas(page, "page int, bits binary")), page_bits


def page_blocks(pages: DataFrame, page_bits: int) -> list[tuple[int, list[int]]]:
    """Runs of pages of `BLOCK_BYTES` each at most, or of one page: the first one's number and all sizes in bytes."""
    sizes = [MIN_PAGE_BITS // 8] * (1 << page_bits)
    for row in pages.select("page", F.octet_length("bits").alias("bytes")).toLocalIterator():
        sizes[row.page] = row.bytes
    blocks, first, held = [], 0, 0
    for page, size in enumerate(sizes):
        if page > first and held + size > BLOCK_BYTES:
            blocks.append((first, sizes[first:page]))
            first, held = page, 0
        held += size
    return [*blocks, (first, sizes[first:])]


def read_block(pages: DataFrame, first: int, sizes: list[int], page_bits: int) -> Filter:
    """A block of pages, in the driver; one page after another."""
    own = pages.filter(F.col("page").between(first, first + len(sizes) - 1))
    return Filter(sizes, ((r.page, r.bits) for r in own.toLocalIterator()), page_bits, first)


def hot_words(words: DataFrame, most: int = MAX_HOT_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count such that at most `most` words have it or more; hashes of these in order, and their counts."""
    capped = 1 << 20
    rows = sorted(words.groupBy(F.least("c", F.lit(capped)).alias("c")).count().collect(), reverse=True)
    least, held = capped + 1, 0
    for c, n in rows:
        held += n
        if held > most:
            break
        least = c
    table = words.filter(F.col("c") >= least).select("h", "c").toArrow()
    hashes, counts = (table[x].to_numpy() for x in ("h", "c"))
    order = np.argsort(hashes)
    return least, hashes[order], counts[order]


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", mu: float = MU) -> DataFrame:
    """Of each row of `docs`: key, n_tokens, n_known, train_tokens, base_score and score, learned from `training`."""
    words = checkpointed(word_counts(training))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, hot, hot_counts = hot_words(words)
    total = n + v + 1
    pages, page_bits = filter_pages(training, words, n)
    blocks = page_blocks(pages, page_bits)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "text")
    context = python_tasks(docs)
    spark, held = docs.sparkSession, None
    for first, sizes in blocks[:-1]:
        block = context.broadcast(read_block(pages, first, sizes, page_bits))
        turned = map_batches(rows, partial(_turn, block), f"row bigint, key {kind}, text string, levels binary")
        before, held = held, work_path(spark, "bloom-lm")
        turned.write.option("compression", "zstd").parquet(f"{held}/rows")
        rows = spark.read.parquet(f"{held}/rows")
        block.destroy()
        if before is not None:
            delete_path(spark, before)
    fixed = context.broadcast((read_block(pages, *blocks[-1], page_bits), hot, hot_counts))

    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {x: [] for x in ("n_tokens", "known", "logs", "score", "rare", "times")}
        for part in chunks(batch["text"], CHUNK_CHARS):
            before = batch["levels"][part] if "levels" in batch else None
            for name, values in _score_chunk(batch["text"][part], before, *fixed.value, total, mu).items():
                out[name].extend(values)
        return {"row": batch["row"], "key": batch["key"]} | out

    scored = checkpointed(map_batches(rows, work, f"""row bigint, key {kind}, n_tokens bigint, known bigint,
        logs double, score double, rare array<bigint>, times array<int>"""))
    if held is not None:
        delete_path(spark, held)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(words.filter(F.col("c") < least), "h").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    return scored.join(met, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(log10(total))).alias("base_score"),
        "score")


class Lookup:
    """Levels of the words and word pairs of a chunk, each looked up once, over those that earlier turns found.

    Between turns a text keeps its tokens' levels and behind them those of the pairs that these end.
    """

    def __init__(self, chunk: Chunk, before: list[bytes] | None, block: Filter):
        self.chunk = chunk
        self.used = np.unique(chunk.tokens)
        context, word, self.text = chunk.pairs()
        rank = np.zeros(len(chunk.hashes), np.int64)
        rank[self.used] = np.arange(len(self.used))
        self.word = rank[word]
        pair, at, self.where = np.unique(
            rank[context] * len(self.used) + self.word, return_index=True, return_inverse=True)
        self.first, self.second = pair // len(self.used), pair % len(self.used)
        hashes = chunk.hashes[self.used]
        self.words = block.levels(word_keys(hashes))
        self.pairs = block.levels(pair_keys(hashes[self.first], hashes[self.second]))
        if before is not None:
            held = np.frombuffer(b"".join(before), np.uint8)
            half = np.concatenate([np.repeat((True, False), size) for size in chunk.n_tokens.tolist()])
            known = np.zeros(len(self.used), np.uint8)
            known[self.word] = held[half]
            self.words, self.pairs = np.maximum(self.words, known), np.maximum(self.pairs, held[~half][at])

    def kept(self) -> list[bytes]:
        words, pairs = self.words[self.word].tobytes(), self.pairs[self.where].tobytes()
        ends = np.cumsum(self.chunk.n_tokens).tolist()
        return [words[a:b] + pairs[a:b] for a, b in zip([0, *ends], ends)]


def _turn(block: Broadcast, batch: dict[str, list]) -> dict[str, list]:
    kept = []
    for part in chunks(batch["text"], CHUNK_CHARS):
        before = batch["levels"][part] if "levels" in batch else None
        kept += Lookup(Chunk(batch["text"][part]), before, block.value).kept()
    return batch | {"levels": kept}


def _score_chunk(texts: list[str | None], before: list[bytes] | None, block: Filter, hot: np.ndarray,
                 hot_counts: np.ndarray, total: int, mu: float) -> dict[str, list]:
    chunk = Chunk(texts)
    n = len(texts)
    found = Lookup(chunk, before, block)
    used, w, text = found.used, found.word, found.text
    means = level_means()
    about, both = means[found.words], means[found.pairs]
    # A start stands before each text, as often as an end behind it.
    about_first = about.copy()
    about_first[used == 0] = about[used == 1]
    both = np.minimum(both, np.minimum(about_first[found.first], about[found.second]))
    logs = np.log10((both + mu * (about[found.second] + 1) / total) / (about_first[found.first] + mu))
    scores = np.bincount(text, logs[found.where], minlength=n)
    # What the base score needs: exact sums over frequent words, and each text's rare words with their number.
    hashes = chunk.hashes[used].view(np.int64)
    slot = np.minimum(np.searchsorted(hot, hashes), max(len(hot) - 1, 0))
    is_hot = hot[slot] == hashes if len(hot) else np.zeros(len(used), bool)
    exact = np.where(is_hot, hot_counts[slot] if len(hot) else 0, 0)
    known = np.bincount(text, is_hot[w], minlength=n).astype(np.int64)
    sums = np.bincount(text, np.log10(exact[w] + 1.0), minlength=n)
    cold = ~is_hot[w]
    rare, times = np.unique(text[cold] * len(used) + w[cold], return_counts=True)
    cuts = np.searchsorted(rare // len(used), np.arange(1, n))
    return {"n_tokens": chunk.n_tokens.tolist(), "known": known.tolist(), "logs": sums.tolist(),
            "score": scores.tolist(), "rare": np.split(hashes[rare % len(used)], cuts),
            "times": np.split(times.astype(np.int32), cuts)}
