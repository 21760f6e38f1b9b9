from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

from pyspark.sql import functions as F

from slotwise.llm.decontamination import WINDOW, Index, find_items, hit_words, items_digest, mark, words_of
from slotwise.llm.texts import give_back
from tests.llm.helpers import clashing, documents, empty_documents, odd_documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(WINDOW, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(name)
    return len(w), len(hit), sorted(found)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string")


def found(spark, texts, items, **options):
    rows = find_items(documents(spark, texts), benchmark(spark, items), **options).withColumn(
        "n_hit", hit_words(F.col("found.spans"))).orderBy("doc_id").collect()
    return [(r.found.n_words, r.n_hit, r.found["items"]) for r in rows]


def cases(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "é", "x1", "the", "of"]
    some = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 9, 10, 11, 14, 30]))) for i in range(25)] + [(7, None), (None, some(12))]
    texts = [some(rng.choice([0, 1, 5, 12, 40, 200])) for _ in range(60)]
    for k in range(0, 60, 3):
        item = items[rng.randrange(25)][1]
        texts[k] = f"{texts[k]} {item.upper()}! {some(4)}, {item}"
    return texts + [None, ""], items


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts, items = cases(seed)
        named = [("null" if i is None else str(i), t) for i, t in items]
        wanted = [brute(t, named) for t in texts]
        assert sum(n > 0 for _, n, _ in wanted) > 20
        assert found(spark, texts, items) == wanted
        assert found(spark, texts, items, block_chars=60) == wanted  # in many blocks


def test_rare_and_frequent_windows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [item, "one two three four five six seven eight nine", f"zero {item} twelve", "ten " * 50,
             "one two three four five six seven eight nine tenth", item.replace(" ", "-").upper()]
    assert [n for _, n, _ in found(spark, texts, [(1, item)])] == [11, 0, 11, 0, 0, 11]
    near = "two three four five six seven eight nine ten eleven"
    assert found(spark, [near + " x"], [(1, item), (2, "x")]) == [(11, 11, ["1", "2"])]


def test_memory_is_bounded_by_chunks_not_by_batches():
    item = "one two three four five six seven eight nine ten"
    index = Index([("1", words_of(item))])
    index.order({})
    texts = ["word " * 4000 + item] * 200 + [None]  # 4 million characters
    held = []
    for work in (lambda: mark(texts, None, index), lambda: index.ids(texts[:50])):
        tracemalloc.start()
        out = work()
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if len(held) == 1:
            assert out.n_words.tolist() == [4010] * 200 + [0]
            assert [len(x) for x in out["items"]] == [1] * 200 + [0] and out.spans[7].tolist() == [4000, 4010]
    # The words' numbers of all texts at once take four times those of 50, and what is found from them some more.
    assert held[0] < 8 * held[1]


def test_freed_memory_goes_back():
    kept = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    pieces = [bytearray(100_000) for _ in range(1000)]
    last = [bytes(1000) for _ in range(1000)]  # noqa: F841  stands behind them, so that the heap can't just shrink
    full = kept()
    del pieces
    give_back()
    assert full - kept() > 60


def test_digest(spark):
    df = spark.createDataFrame([(["10", "9"],), ([],)], "items array<string>")
    import hashlib
    assert [r[0] for r in df.select(items_digest(F.col("items"))).collect()] == [
        hashlib.sha256(b"10,9").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["spans", "items"])
    out = find_items(docs, benchmark(spark, [(1, "a"), (2, "")]))
    assert out.count() == docs.count() and out.columns == [*docs.columns, "found"]
    assert out.filter("text is null and (found.n_words <> 0 or size(found.items) <> 0)").count() == 0
    assert find_items(docs, benchmark(spark, [])).filter("size(found.items) > 0").count() == 0
    assert find_items(empty_documents(spark), benchmark(spark, [(1, "a")])).count() == 0
