from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotwise.llm import simhash_trie as st
from slotwise.llm.queries import op10_simhash_trie
from tests.llm.helpers import clashing, documents, empty_documents, odd_documents
from tests.llm.test_oracles import SF_DIR


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, budget=3):
    """Smallest key of each component, by comparing all fingerprints with each other."""
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= budget) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(keys))]


def close_prints(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        x = rng.choice(base[:5] if len(out) % 2 else out)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def labels_of(values, budget):
    return brute_components(list(range(len(values))), values, budget)


@pytest.mark.parametrize("budget", [1, 3, 5])
def test_walk_against_all_pairs(budget, monkeypatch):
    monkeypatch.setattr(st, "PAIRS", 500)
    for seed in range(3):
        values = close_prints(600, seed)
        assert st.near_components(values, None, budget).tolist() == labels_of(values, budget)


def test_walk_of_two_tries(monkeypatch):
    values = close_prints(700, 9)
    for left in (values[::2], values[:1], values[:650]):
        right = np.setdiff1d(values, left)
        labels = st.near_components(left, right, 3)
        both = np.concatenate((left, right))
        near = np.bitwise_count(left[:, None] ^ right[None, :]) <= 3
        wanted = np.arange(len(both))
        for i, j in zip(*np.nonzero(near)):
            wanted = st._unite(wanted, np.array([i]), np.array([j + len(left)]))
        assert labels.tolist() == wanted.tolist()
    assert st.near_components(values[:1], None).tolist() == [0]


def test_a_ball_of_near_copies_is_cheap():
    """Fingerprints within a few bits of each other: pairs grow with the square, what is walked does not."""
    rng = np.random.default_rng(1)
    ball = np.full(6000, 0x0123456789ABCDEF, np.uint64)
    for _ in range(4):
        ball ^= np.uint64(1) << rng.integers(0, 14, len(ball)).astype(np.uint64)
    ball = np.unique(ball)
    x = st.Trie(ball)
    labels = st.near_components(ball, None)
    assert set(labels) == {0}
    assert sum(len(i) for i, _ in st.walk(x, x, 3, (labels, labels))) == 0


def edits_of_blocks(budget):
    """A fingerprint far from all others for each way to spread `budget` bits over the blocks, and one so far from it."""
    rng = random.Random(budget)
    ends = [*st.BLOCKS, st.BITS]
    out = []
    for a in range(budget + 1):
        for b in range(budget + 1 - a):
            x = y = rng.getrandbits(64)
            for block, n in enumerate((a, b, budget - a - b)):
                for bit in rng.sample(range(ends[block], ends[block + 1]), n):
                    y ^= 1 << st.BITS - 1 - bit
            out.append((x, y))
    return out


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 4, 5, 8])
def test_one_block_of_each_link_has_few_differing_bits(spark, budget):
    pairs = edits_of_blocks(budget)
    values = np.unique(np.array(pairs, np.uint64))
    assert st.near_components(values, None, budget).tolist() == labels_of(values, budget)
    left, right = (np.sort(np.array(side, np.uint64)) for side in zip(*pairs, strict=True))
    if budget:
        labels = st.near_components(left, right, budget)
        assert all(labels[np.searchsorted(left, np.uint64(x))] == labels[len(left) + np.searchsorted(right, np.uint64(y))]
                   for x, y in pairs)
    if budget in (1, 4, 5):
        prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
        roots = {r.node: r.root for r in st.components(st.near_links(prints, len(values), budget, 1)).collect()}
        signed = [tuple(np.array(p, np.uint64).view(np.int64).tolist()) for p in pairs]
        assert all(roots.get(x, x) == roots.get(y, y) for x, y in signed)


def test_few_nodes_are_walked_near_the_root(monkeypatch):
    """Without links the pairs of nodes grow with the fingerprints, not with all paths within the budget."""
    walked, down = [], st._down
    monkeypatch.setattr(st, "_down", lambda trie, depth, nodes: (walked.append(len(nodes)), down(trie, depth, nodes))[1])
    values = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1))
    assert st.near_components(values, None, 4).tolist() == list(range(len(values)))
    assert sum(walked) < 500 * len(values)


def test_a_fingerprint_goes_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(st, "_walked", lambda pairs, budget, whole: pairs)
    values = (np.unique(np.random.default_rng(6).integers(0, 1 << 63, 3000, dtype=np.uint64)) << np.uint64(1)).view(np.int64)
    prints = spark.createDataFrame([(int(v),) for v in values], "fingerprint bigint")
    # 64 cells of a trie, none of which needs chunks.
    assert st.near_links(prints, 64 * 1000, 4, 1000).count() == (2 * 6 + 3) * len(values)


def test_fingerprints(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()][:120]
    for text in [*texts, None, "", "one", "Two words", " a\x1cb c", "a b c", "x " * 70_000]:
        for size in (1, 3, 5):
            assert st.majority(st.shingles(text, size)) == brute_print(text, size)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [brute_print(docs[i]) for i in ids]
    rows = {r.doc_id: r for r in op10_simhash_trie(spark, SF_DIR).collect()}
    assert [int(rows[i].fingerprint, 16) for i in ids] == prints and all(len(r.fingerprint) == 16 for r in rows.values())
    assert [rows[i].component_id for i in ids] == brute_components(ids, prints)


@pytest.mark.parametrize("cell", [7, 60, 10_000])
def test_cells_and_chunks_lose_no_link(spark, cell):
    values = close_prints(400, 4)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    links = st.near_links(prints, 30 if cell == 7 else len(values), 3, cell)
    roots = {r.node: r.root for r in st.components(links).collect()}
    signed = values.view(np.int64).tolist()
    wanted = labels_of(values, 3)
    groups = {}
    for value, label in zip(signed, wanted, strict=True):
        groups.setdefault(label, []).append(value)
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 200), (200, 250)]
    links = spark.createDataFrame([(max(e), min(e)) for e in edges], "u bigint, v bigint")
    roots = {r.node: r.root for r in st.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {300: 200, 250: 200}


def test_several_hashes_find_more(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(150)]
        texts.append(" ".join(words))
        for p in rng.sample(range(150), 3):
            words[p] = word()
        texts.append(" ".join(words))
    docs = documents(spark, texts)
    found = {}
    for seeds in ((42,), (42, 43, 44, 45)):
        rows = {r.key: r.component for r in st.near_duplicates(docs, shingle=1, budget=4, seeds=seeds, distinct=True).collect()}
        assert all(c in (k, k - 1) and c % 2 == 0 or c == k for k, c in rows.items())
        found[seeds] = sum(rows[2 * i + 1] == 2 * i for i in range(40))
    assert found[42, 43, 44, 45] >= max(34, found[(42,)])


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["key", "f0", "component", "root"])
    rows = docs.collect()
    out = [(r.key, r.f0 % 2**64, r.component) for r in st.near_duplicates(docs).collect()]
    keys, prints = [r.doc_id for r in rows], [brute_print(r.text) for r in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(out, key=order) == sorted(zip(keys, prints, brute_components(keys, prints), strict=True), key=order)
    assert st.near_duplicates(empty_documents(spark)).count() == 0
    assert st.near_duplicates(docs.filter("doc_id is null")).filter(F.col("component").isNotNull()).count() == 0
