"""Importance resampling against a plain version in one process."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from slotwise.llm import resampling
from slotwise.llm.resampling import Buckets, resample, words_with_offsets
from tests.llm.helpers import ODD_TEXTS, clashing, empty_documents, odd_documents

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def runs(found, most):
    return [" ".join(found[i : i + n]) for n in range(1, most + 1) for i in range(len(found) - n + 1)]


def plain(rows, target, percent, least, seed, buckets, most):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [text for _, text in rows]), (t, target)):
        for text in texts:
            for feature in runs(words(text), most):
                counts[bucket(feature)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        found = runs(words(text), most)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(n, seed=1):
    draw = random.Random(seed)
    names = [f"word{i}" for i in range(60)] + ["É", "straße", "日本", "x1"]
    return [" ".join(draw.choice(names) for _ in range(draw.randrange(40))) + draw.choice(["", ".", " - "]) for _ in range(n)]


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (3, 500, 37), (2, 70_000, 100)])
def test_against_a_plain_version(spark, most, buckets, percent):
    rows = list(enumerate(texts(300))) + [(7, "word1 " * 30)] * 4 + [(None, "word2 " * 25), (400, None), (401, "")]
    target = texts(20, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample(docs, wanted, percent=percent, buckets=buckets, most=most)
    given = sorted((tuple(r) for r in found.collect()), key=str)
    expected = plain(rows, target, percent, 20, 2024, buckets, most)
    # Rows with equal id and text tie in everything, so which of their ranks is whose is open.
    assert given == expected


def test_odd_documents(spark):
    docs = clashing(odd_documents(spark), ["weight", "rank", "_row", "a.b"])
    target = clashing(docs.select("text"), ["none", "doc_id"])
    found = resample(docs, target)
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, [t for _, t in rows], 10, 20, 2024, 10_000, 1)


def test_empty_tables(spark):
    none = empty_documents(spark)
    assert resample(none, none).collect() == []
    assert resample(odd_documents(spark), none).count() == odd_documents(spark).count()


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_do_not_change_words_or_runs(piece):
    line = " ".join(t for t in [*texts(20, 5), *ODD_TEXTS] if t and len(t) < 5000)
    parts = [part[s:e] for part, offsets in words_with_offsets(line, piece) for s, e in offsets]
    assert parts == words(line)
    of = Buckets(10_000, 3)
    n, packed = of.of(line, piece)
    assert (n, sorted(packed)) == (len(parts), sorted(of.of(line)[1]))
    assert len(packed) == 2 * len(runs(parts, 3))


def test_a_full_memory_changes_nothing(monkeypatch):
    of = Buckets(10_000, 1)
    whole = of.of(" ".join(texts(20)))
    monkeypatch.setattr(resampling, "REMEMBERED", 3)
    assert Buckets(10_000, 1).of(" ".join(texts(20))) == whole
