from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from slotwise.llm import simhash_trie
from slotwise.llm.merge_dropout import decode
from tests.llm.helpers import clashing, documents, empty_documents, odd_documents
from tests.llm.test_decontamination import brute as brute_windows
from tests.llm.test_oracles import SF_DIR

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of what the one before it kept."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR).cache()
        out.append((name, before, docs))
    return out


def test_stages_in_order(stages):
    assert [n for n, _, _ in stages] == ["language", "near_copies", "benchmark_passages", "personal_data", "encoding"]
    assert all(docs.columns == COLUMNS for _, _, docs in stages[:-1])
    assert set(COLUMNS) < set(stages[-1][2].columns)


def test_run_is_the_stages_one_after_another(spark, stages):
    rows = cp.run(spark, SF_DIR)
    assert sorted(map(str, rows.collect())) == sorted(map(str, stages[-1][2].collect()))


def test_language_keeps_clean_text(stages):
    _, before, after = stages[0]
    assert before.join(after, "doc_id", "left_anti").filter("length(text) > 60").count() == 0


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_against_all_pairs(stages):
    """Equal texts leave one; what goes is like something that stays or went; nothing else goes."""
    _, before, after = stages[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len({texts[i] for i in kept}) == len(kept)
    shingles = {i: five(t) for i, t in texts.items()}
    for i in set(texts) - kept:
        near = max(len(shingles[i] & s) / len(shingles[i] | s) for j, s in shingles.items() if j != i)
        assert near >= 0.4
    assert {min(i for i in texts if texts[i] == t) for t in set(texts.values())} >= kept


def test_benchmark_passages_against_brute_force(spark, stages):
    _, before, after = stages[2]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    wanted = {r.doc_id for r in before.collect() if not brute_windows(r.text, items)[1]}
    assert {r.doc_id for r in after.collect()} == wanted


def test_personal_data_and_encoding(spark, stages):
    _, before, after = stages[3]
    assert before.count() == after.count() and after.filter("n_chars <> length(text)").count() == 0
    personal = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|[a-z]+\.[0-9]{2}@mail[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    old = before.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(personal), F.lit(0))).alias("value"))
    assert old.count() > 0 and old.join(after, "doc_id").filter("contains(text, value)").count() == 0
    _, before, after = stages[4]
    assert decode(after).filter("not (text <=> decoded)").count() == 0
    assert after.select(COLUMNS).subtract(before).count() == 0 and after.count() == before.count()
    assert after.filter("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    name, function = cp.STAGES[stage]
    docs = clashing(odd_documents(spark), ["_found", "_row", "_key", "doc", "pii_email", "a.b"])
    out = function(spark, docs, SF_DIR)
    assert [c for c in out.columns if c not in ("ids", "n_tokens")] == docs.columns
    assert out.filter("_found <> 'mine' or _row <> 'mine' or doc <> 'mine' or pii_email <> 'mine'").count() == 0
    assert out.count() == {"language": out.count(), "near_copies": out.count()}.get(name, docs.count())
    if name == "near_copies":
        assert out.filter("text is null or text = ''").count() <= 1 and out.filter("text = 'a'").count() == 1
    assert function(spark, empty_documents(spark), SF_DIR).count() == 0


def test_the_library_works_without_the_subpackage(tmp_path):
    root = Path(cp.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    assert run.stdout.split()[1] == "True" and int(run.stdout.split()[0]) >= 58


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_are_verified(stages):
    """What goes has a document of five-word similarity 0.8 or more."""
    _, before, after = stages[1]
    shingles = {r.doc_id: five(r.text) for r in before.collect()}
    gone = set(shingles) - {r.doc_id for r in after.collect()}
    assert all(max(similarity(shingles[i], s) for j, s in shingles.items() if j != i) >= 0.8 for i in gone)


@pytest.mark.parametrize("part", [1024, 3])
def test_near_copies_with_block_edits(spark, monkeypatch, part):
    """Another text appended, put in front or cut away in one block: pairs of 0.8 or more leave one, others two."""
    monkeypatch.setattr(simhash_trie, "PART", part)
    monkeypatch.setattr(simhash_trie, "PACK", 50)
    rng, texts = random.Random(3), []
    for n in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        other = [f"w{rng.randrange(5000)}" for _ in range(int(len(words) * rng.choice((0.02, 0.05, 0.1, 0.15, 0.2, 0.5))))]
        texts += [words, (words + other, other + words, words[len(other):])[n % 3]]
    texts = [" ".join(t) for t in texts]
    kept = {r.doc_id for r in cp.near_copies(spark, documents(spark, texts), SF_DIR).collect()}
    alike = {i + 1 for i in range(0, 400, 2) if similarity(five(texts[i]), five(texts[i + 1])) >= 0.8}
    gone = set(range(400)) - kept
    assert gone <= alike and len(gone) >= 0.97 * len(alike) and len(alike) > 100


@pytest.mark.parametrize("part", [1024, 40])
def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch, part):
    """One text with a few words changed in each of many copies: components are those of all pairs."""
    monkeypatch.setattr(simhash_trie, "PART", part)
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]

    def edited():
        copy = list(words)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        return " ".join(copy)

    texts = [edited() for _ in range(400)]
    sets = [five(t) for t in texts]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = {r.doc_id for r in cp.near_copies(spark, documents(spark, texts), SF_DIR).collect()}
    assert kept == {i for i in range(400) if root(i) == i} and 1 < len(kept) < 400


def test_components_of_sets_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash_trie, "COLUMNS", 5)
    rng = random.Random(2)
    pool = [np.unique(np.array(rng.sample(range(200), rng.randrange(60)), np.uint64)) for _ in range(60)]
    pool += [np.delete(s, 0) for s in pool if len(s) > 1] + [pool[0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    counts = simhash_trie.common_features(pool)
    for i, a in enumerate(pool):
        for j, b in enumerate(pool):
            assert i == j or counts[i, j] == len(np.intersect1d(a, b))
    labels = simhash_trie.alike_components(pool, 0.8)
    links = {(i, j) for i in range(len(pool)) for j in range(i) if len(np.union1d(pool[i], pool[j]))
             and len(np.intersect1d(pool[i], pool[j])) / len(np.union1d(pool[i], pool[j])) >= 0.8}
    assert all(labels[i] == labels[j] for i, j in links)
    assert {(i, j) for i in range(len(pool)) for j in range(i) if labels[i] == labels[j]} == closure(links, len(pool))


def test_features_are_counted_in_parts(monkeypatch):
    rng = random.Random(4)
    pool = [np.unique(np.array(rng.sample(range(300), rng.randrange(80)), np.uint64)) for _ in range(50)]
    for counted in (1, 50, 1 << 20):
        monkeypatch.setattr(simhash_trie, "COUNTED", counted)
        counts = simhash_trie.common_features(pool)
        assert all(counts[i, j] == len(np.intersect1d(pool[i], pool[j])) for i in range(50) for j in range(50) if i != j)


def test_a_set_is_sent_once_to_the_groups_of_a_task(spark, monkeypatch):
    """Overlapping groups of the same copies: links as of all pairs in each group, each set unpacked from one row."""
    rng = random.Random(5)
    base = rng.sample(range(1 << 40), 60)
    sets = {c: np.array(sorted(x << 24 for x in base[: 60 - c] + rng.sample(range(1 << 40), c)), np.uint64) for c in range(9)}
    rows = [(g, c) for g in range(12) for c in range(9) if c == 0 or rng.random() < 0.7]
    seen, frame = [], type(spark.range(0))
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *a, **b: (seen.append(self) if "groups" in self.columns else None, join(self, other, *a, **b))[1])
    links = simhash_trie._compared(
        spark.createDataFrame(rows, "group bigint, class bigint"),
        spark.createDataFrame([(c, simhash_trie.packed(s)) for c, s in sets.items()], "class bigint, features binary"), 0.8)
    found = {(r.u, r.v) for r in links.collect()}
    wanted = {(max(i, j), min(i, j)) for g in range(12) for _, i in rows for _, j in rows if i != j
              and (g, i) in rows and (g, j) in rows and similarity({*sets[i].tolist()}, {*sets[j].tolist()}) >= 0.8}
    assert closure(found, 9) == closure(wanted, 9) and found
    assert seen[0].count() == 9


def closure(links, n):
    """Pairs that links connect."""
    reach = np.eye(n, dtype=bool)
    for i, j in links:
        reach[i, j] = reach[j, i] = True
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    return {(i, j) for i in range(n) for j in range(i) if reach[i, j]}
