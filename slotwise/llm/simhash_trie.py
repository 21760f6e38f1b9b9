"""SimHash near-duplicates by a self-join of a binary trie over fingerprints.

Fingerprints are 64 bits of word shingles. Two documents link if their fingerprints differ in at most `budget` bits,
and components of links are near-duplicate groups.

The join walks pairs of trie nodes together from the root. A pair carries the number of bits in which the two paths
differ; it is dropped once that exceeds the budget, and compared directly once both nodes hold one fingerprint. Near the
root every node has children, and all paths within the budget would be walked there; so the bits lie in three blocks,
and there are three tries, each with another block first. Fingerprints that differ in `budget` bits differ in few of
some block's, by `spread`, and a pair that exceeds these in its trie's first block is dropped too: it lies in the few of
another trie. So the nodes walked per fingerprint are about as many as the first block has bits, not C(bits, budget).

On Spark the first `depth` bits of each trie are cells: a pair of cells that differ in few bits is a group of its own,
walked by one task. `depth` follows the number of fingerprints, and a cell with more than `CELL` of them is cut into
chunks whose pairs become groups, so a group never holds more than about two chunks; as many as two chunks are one group
for all three tries. Each fingerprint goes to sum(C(depth, i), i <= few) cells of each trie, 2 * depth + 3 for a budget
of 4; that is the price of walking a trie whose parts lie on different machines.

Walks go budget by budget, and a pair of subtrees that are already known to be one component is not walked again:
a dense ball of near copies costs about as much as its fingerprints, not as its pairs. A group returns a star per
component, whose links join others' in a large-star / small-star iteration over checkpoints in the shared folder.

Copies count once: fingerprints are made distinct, with map-side combination, before they are joined. A null or empty
text has fingerprint 0 and links as any other. Null ids take part but never name a component unless all ids are null.
Repeated rows keep their rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.shared import checkpointed
from slotwise.llm.texts import give_back, map_batches, python_tasks

SEED = 42
BITS = 64
BUDGET = 3
#: Where the blocks of a fingerprint's bits start, from the highest bit; a cell is named by its block and a prefix of it.
BLOCKS, PREFIX = (0, 22, 43), 20
#: Fingerprints of a cell that one chunk takes; a group holds two chunks at most.
CELL = 1 << 17
#: Node pairs that are walked at once.
PAIRS = 1 << 17
#: Sets of a similarity of 0.8 meet in one of the bands with a probability of 0.998.
BANDS, ROWS = 20, 6
#: Sets of a group that a task compares all with all, or with as many of another part of the group; and their features.
PART, PART_FEATURES = 1024, 1 << 22
#: Bytes of a shingle's hash that are sent to where sets are compared.
WIDTH = 5
#: Members of small groups that one task takes.
PACK = 4096
#: Features that more sets than this share are counted by a product of matrices, of so many columns at a time; others by
#: the pairs of sets that share them, of which so many are held.
RARE, COLUMNS, COUNTED = 32, 4096, 1 << 20

_ALL = 0xFFFFFFFFFFFFFFFF
_RANDOM = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1] * np.uint64(2)

def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of `size` words, or all words if there are fewer, each joined by single spaces."""
    words = text.encode().lower().split() if text else []
    size = min(size, len(words))
    if not size:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return [line[s:e] for s, e in spans]


def majority(features: list[bytes], seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the features' hashes; 0 without features."""
    if not features:
        return 0
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), features), np.uint64, len(features))
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = 3, seeds: tuple[int, ...] = (SEED,),
                 distinct: bool = False) -> DataFrame:
    """key and fingerprints f0, f1, … (BIGINTs with the same bits) of every row, one per seed."""
    def work(batch: dict[str, list]) -> dict[str, list]:
        out = np.zeros((len(seeds), len(batch["text"])), np.uint64)
        for i, text in enumerate(batch["text"]):
            features = shingles(text, shingle)
            if distinct:
                features = [*dict.fromkeys(features)]
            for k, seed in enumerate(seeds):
                out[k, i] = majority(features, seed)
        return {"key": batch["key"]} | {f"f{k}": row.view(np.int64) for k, row in enumerate(out)}

    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"f{k} bigint" for k in range(len(seeds)))
    return map_batches(docs.select(F.col(key).alias("key"), "text"), work, f"key {kind}, {columns}")


class Trie:
    """Levels of a binary trie over sorted distinct fingerprints: a node is a range of them with a common prefix."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.starts, self.sizes, self.children = [np.zeros(1, np.int32)], [np.array([len(values)], np.int32)], []
        for depth in range(BITS):
            if self.sizes[-1].max() == 1:
                break
            prefix = values >> np.uint64(BITS - 1 - depth)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(prefix)) + 1)).astype(np.int32)
            first = np.searchsorted(starts, self.starts[-1]).astype(np.int32)
            ones = (prefix[self.starts[-1]] & np.uint64(1)).astype(bool)
            count = np.diff(np.append(first, len(starts)))
            none = np.int32(-1)
            self.children.append((np.where(ones, none, first), np.where(ones, first, np.where(count == 2, first + 1, none))))
            self.starts.append(starts)
            self.sizes.append(np.diff(np.append(starts, len(values))).astype(np.int32))

    def single_component(self, labels: np.ndarray) -> list[np.ndarray]:
        """Of each node by depth: its component, or -1 if it holds several."""
        out = []
        for starts in self.starts:
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            out.append(np.where(low == high, low, -1).astype(np.int32))
        return out


def spread(budget: int) -> list[int]:
    """Differing bits in each block: two fingerprints within the budget have so few in one block at least; -1: none."""
    return [(budget - block) // len(BLOCKS) for block in range(len(BLOCKS))]


def turned(values: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints whose bits from `start` on come first."""
    return values << np.uint64(start) | values >> np.uint64(BITS - start) if start else values


def walk(x: Trie, y: Trie, budget: int, known: tuple[np.ndarray, np.ndarray], few: int = BITS,
         span: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of fingerprints of `x` and `y` within the budget, in parts; `y is x` gives each pair once.

    Of the first `span` bits no more than `few` need differ: what exceeds that may be left out. Pairs whose subtrees are
    one component, by the labels in `known`, are left out.
    """
    same = x is y
    marks_x = x.single_component(known[0])
    marks_y = marks_x if same else y.single_component(known[1])
    root = np.zeros(1, np.int32)
    stack = [(0, root, root, np.zeros(1, np.int8))]
    while stack:
        depth, a, b, bits = stack.pop()
        if len(a) > PAIRS:
            # Copies, for a slice would keep the whole until all its parts are done.
            stack += [(depth, *(x[k : k + PAIRS].copy() for x in (a, b, bits))) for k in range(0, len(a), PAIRS)]
            continue
        # A level at which all nodes are single is the last one; deeper ones of the other trie meet it as it is.
        dx, dy = min(depth, len(x.starts) - 1), min(depth, len(y.starts) - 1)
        keep = (marks_x[dx][a] != marks_y[dy][b]) | (marks_x[dx][a] < 0)
        a, b, bits = a[keep], b[keep], bits[keep]
        single = (x.sizes[dx][a] == 1) & (y.sizes[dy][b] == 1)
        i, j = x.starts[dx][a[single]], y.starts[dy][b[single]]
        near = np.bitwise_count(x.values[i] ^ y.values[j]) <= budget
        near &= (i < j) if same else True
        if near.any():
            yield i[near], j[near]
        a, b, bits = a[~single], b[~single], bits[~single]
        if not len(a):
            continue
        # A node of one fingerprint goes down by the fingerprint's own bits.
        (a0, a1), (b0, b1) = _down(x, depth, a), _down(y, depth, b)
        twin = (a == b) if same else np.zeros(len(a), bool)
        most = min(few, budget) if depth < span else budget
        parts = [(a0, b0, bits, None), (a1, b1, bits, None), (a0, b1, bits + 1, None), (a1, b0, bits + 1, ~twin)]
        up, vp, bp = [], [], []
        for u, v, n, also in parts:
            ok = (u >= 0) & (v >= 0) & (n <= most)
            if also is not None:
                ok &= also
            up.append(u[ok]), vp.append(v[ok]), bp.append(n[ok])
        stack.append((depth + 1, np.concatenate(up), np.concatenate(vp), np.concatenate(bp)))


def _down(trie: Trie, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if depth < len(trie.children):
        zero, one = trie.children[depth]
        return zero[nodes], one[nodes]
    ones = (trie.values[trie.starts[-1][nodes]] >> np.uint64(BITS - 1 - depth)) & np.uint64(1) > 0
    return np.where(ones, np.int32(-1), nodes), np.where(ones, nodes, np.int32(-1))


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of i and j; a label is the smallest position of its component."""
    while True:
        u, v = labels[i], labels[j]
        apart = u != v
        if not apart.any():
            return labels
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        labels = parent[labels]


def near_components(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET,
                    blocks: tuple[int, ...] = tuple(range(len(BLOCKS)))) -> np.ndarray:
    """Component labels of `left` followed by `right` by links between the two, or within `left` if right is None.

    Both are sorted and distinct and have nothing in common. Of the tries only those that begin with one of `blocks` are
    walked; the links of the others may be missing.
    """
    labels = np.arange(len(left) + (0 if right is None else len(right)))
    for block in blocks:
        labels = _block_components(left, right, budget, block, labels)
    return labels


def _block_components(left: np.ndarray, right: np.ndarray | None, budget: int, block: int, labels: np.ndarray) -> np.ndarray:
    """Labels after the links of the tries that begin with `block`, which go when they are walked."""
    start, n = BLOCKS[block], len(left)
    places = [np.argsort(turned(v, start)) for v in (left, right) if v is not None]
    tries = [Trie(turned(v[at], start)) for v, at in zip((left, right), places, strict=False)]
    i_at, j_at = places[0], places[-1] + (0 if right is None else n)
    for bits in range(1, budget + 1):
        few = spread(bits)[block]
        if few >= 0:
            span = (*BLOCKS, BITS)[block + 1] - start
            for i, j in walk(tries[0], tries[-1], bits, (labels[i_at], labels[j_at]), few, span):
                labels = _unite(labels, i_at[i], j_at[j])
    return labels


def _cells(own: Column, depth: int, few: list[int]) -> Column:
    """All cells of the same block whose prefix differs from that of `own` in few bits."""
    masks = F.array(*(F.array(*(F.lit(m) for m in range(1 << depth) if m.bit_count() <= most)) for most in few if most >= 0))
    return F.transform(masks[F.shiftright(own, PREFIX)], lambda m: own.bitwiseXOR(m))


def near_links(prints: DataFrame, total: int, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """Links u, v (u > v as signed numbers) that connect what lies within the budget, from distinct `fingerprint`s."""
    if total <= 2 * cell:
        zeros = {c: F.lit(0) for c in ("a", "b", "i", "j")}
        return _walked(prints.select("fingerprint", F.lit(True).alias("lower")).withColumns(zeros), budget, True)
    depth, few = min(PREFIX, ceil(log2(total / cell))), spread(budget)
    # The blocks with links to seek are the first ones.
    own = [F.shiftrightunsigned(_turned(F.col("fingerprint"), start), BITS - depth).cast("int") + F.lit(block << PREFIX)
           for block, (start, most) in enumerate(zip(BLOCKS, few, strict=True)) if most >= 0]
    cells = prints.select("fingerprint", F.explode(F.array(*own)).alias("own"))
    sizes = cells.groupBy("own").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("chunks"))
    cut = (
        cells.join(sizes, "own")
        .select("fingerprint", "own", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int").alias("chunk"))
    )
    # Toward every near cell with all its chunks; a chunk pair is named by (cell, chunk) in order.
    other = (
        cut.select("*", F.explode(_cells(F.col("own"), depth, few)).alias("other"))
        .join(sizes.select(F.col("own").alias("other"), F.col("chunks").alias("others")), "other")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other_chunk"))
    )
    here, there = F.struct("own", "chunk"), F.struct("other", "other_chunk")
    pairs = other.select(
        "fingerprint", (here <= there).alias("lower"),
        F.least(F.col("own"), F.col("other")).alias("a"), F.greatest(F.col("own"), F.col("other")).alias("b"),
        F.when(F.col("own") < F.col("other"), F.col("chunk")).when(F.col("own") > F.col("other"), F.col("other_chunk"))
        .otherwise(F.least("chunk", "other_chunk")).alias("i"),
        F.when(F.col("own") < F.col("other"), F.col("other_chunk")).when(F.col("own") > F.col("other"), F.col("chunk"))
        .otherwise(F.greatest("chunk", "other_chunk")).alias("j"),
    )
    return _walked(pairs, budget, False)


def _turned(fingerprint: Column, start: int) -> Column:
    return F.shiftleft(fingerprint, start).bitwiseOR(F.shiftrightunsigned(fingerprint, BITS - start)) if start else fingerprint


def _walked(pairs: DataFrame, budget: int, whole: bool) -> DataFrame:
    """The links of each pair of chunks, in the trie of their cells' block; or in all tries, if the chunks are `whole`."""
    def join(group: pd.DataFrame) -> pd.DataFrame:
        values, lower = group.fingerprint.to_numpy().view(np.uint64), group.lower.to_numpy()
        within = (group.a.iat[0], group.i.iat[0]) == (group.b.iat[0], group.j.iat[0])
        left = np.sort(values[lower])
        right = None if within else np.sort(values[~lower])
        if not len(left) or (right is not None and not len(right)):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        blocks = tuple(range(len(BLOCKS))) if whole else (int(group.a.iat[0]) >> PREFIX,)
        labels = near_components(left, right, budget, blocks)
        give_back()
        nodes = (left if right is None else np.concatenate((left, right))).view(np.int64)
        linked = labels != np.arange(len(labels))
        u, v = nodes[linked], nodes[labels[linked]]
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    python_tasks(pairs)
    return pairs.groupBy("a", "b", "i", "j").applyInPandas(join, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every linked node, by large-star and small-star turns.

    A turn is two joins of links with the smallest neighbour of each node, which is aggregated map-side first, so a
    node with many links is no group of its own. Each turn is checkpointed; their number grows as log² of the nodes.
    """
    links = checkpointed(links)
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())
        was, state = state, _state(links)
        if was == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.hash("u", "v")).cast("long"))).first())


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = 3, budget: int = BUDGET,
                    seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> DataFrame:
    """key, component (the smallest key reachable by links) and fingerprints f0, … of every row.

    With several seeds each has a trie of its own, and documents link if one of them says so: near copies that miss
    the budget under one hash meet it under another.
    """
    rows = checkpointed(fingerprints(docs, key, shingle, seeds, distinct))
    prints = [f"f{k}" for k in range(len(seeds))]
    # A class is what has equal fingerprints; it is named by its fingerprint, or a hash of several.
    name = F.col("f0") if len(prints) == 1 else F.xxhash64(*prints)
    classes = checkpointed(rows.groupBy(*prints).agg(F.min("key").alias("first")).withColumn("class", name))
    roots = components(_trie_links(classes, prints, budget, len(prints) > 1)).withColumnsRenamed({"node": "class"})
    named = checkpointed(classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(named.join(firsts, "root").select(*prints, "component"), prints).select("key", "component", *prints)


def _trie_links(classes: DataFrame, prints: list[str], budget: int, equal: bool) -> DataFrame:
    """Links u > v of classes, a trie for each of `prints`; with `equal`, classes may share a fingerprint, and link."""
    total, links = classes.count(), None
    for print_ in prints:
        reps = classes.groupBy(F.col(print_).alias("fingerprint")).agg(F.min("class").alias("class"))
        near = near_links(reps.select("fingerprint"), total, budget)
        named = [reps.select(F.col("fingerprint").alias(x), F.col("class").alias(f"{x}_class")) for x in "uv"]
        found = near.join(named[0], "u").join(named[1], "v").select(F.col("u_class").alias("u"), F.col("v_class").alias("v"))
        if equal:
            same = classes.select(F.col(print_).alias("fingerprint"), F.col("class").alias("u")).join(reps, "fingerprint")
            found = found.unionByName(same.select("u", F.col("class").alias("v")))
        found = found.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = found if links is None else links.unionByName(found)
    return links.distinct()


def set_bands(features: np.ndarray) -> list[int]:
    """Hashes of `ROWS` minima each: sets of a similarity s share one with probability 1 - (1 - s**ROWS)**BANDS."""
    if not len(features):
        return []
    least = np.full(BANDS * ROWS, _ALL, np.uint64)
    for at in range(0, len(features), 2048):
        np.minimum(least, (features[at : at + 2048, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), seed=k)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, each once, in order."""
    hashes = set(map(xxhash.xxh64_intdigest, shingles(text, shingle)))
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def _copy_rows(docs: DataFrame, key: str, shingle: int, words: int, seeds: tuple[int, ...]) -> DataFrame:
    """key, class (a hash of the set of shingles), the set's bands, and fingerprints of distinct `words`."""
    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"class": [], "bands": []} | {f"f{k}": [] for k in range(len(seeds))}
        for text in batch["text"]:
            features = _features(text, shingle)
            out["class"].append(_signed(xxhash.xxh64_intdigest(features.tobytes())))
            out["bands"].append(set_bands(features))
            parts = [*dict.fromkeys(shingles(text, words))]
            for k, seed in enumerate(seeds):
                out[f"f{k}"].append(_signed(majority(parts, seed)))
        return {"key": batch["key"]} | out

    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"f{k} bigint" for k in range(len(seeds)))
    return map_batches(docs.select(F.col(key).alias("key"), "text"), work,
                       f"key {kind}, class bigint, bands array<bigint>, {columns}")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """class, and features (the set of its text's shingles, packed)."""
    def work(batch: dict[str, list]) -> dict[str, list]:
        return {"class": batch["class"], "features": [packed(_features(t, shingle)) for t in batch["text"]]}

    return map_batches(texts.select("class", "text"), work, "class bigint, features binary")


def packed(features: np.ndarray) -> bytes:
    """The upper `WIDTH` bytes of each of a set's hashes.

    Two sets of n and m shingles seem to share one more than they do with a probability of n * m / 2**40.
    """
    return features.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def common_features(sets: list[np.ndarray]) -> np.ndarray:
    """How many features each two of some sets share."""
    n = len(sets)
    counts = np.zeros(n * n, np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [*map(len, sets)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1])))
    sharers = np.diff(np.append(starts, len(flat)))
    pairs, held = [], 0
    for k in range(2, min(RARE, n) + 1):
        at = starts[sharers == k]
        if not len(at):
            continue
        i, j = np.triu_indices(k, 1)
        for part in np.array_split(at, max(1, -(-len(at) * len(i) // COUNTED))):
            owners = owner[part[:, None] + np.arange(k)]
            pairs.append((owners[:, i] * n + owners[:, j]).reshape(-1))
            held += len(pairs[-1])
            if held >= COUNTED:
                counts += np.bincount(np.concatenate(pairs), minlength=n * n)
                pairs, held = [], 0
    if held:
        counts += np.bincount(np.concatenate(pairs), minlength=n * n)
    counts = counts.reshape(n, n)
    counts += counts.T
    often = np.flatnonzero(sharers > RARE)
    for part in np.array_split(often, max(1, -(-len(often) // COLUMNS))):
        holds = np.zeros((n, len(part)), np.float32)
        for column, run in enumerate(part.tolist()):
            holds[owner[starts[run] : starts[run] + sharers[run]], column] = 1
        counts += (holds @ holds.T).astype(np.int64)
    return counts


def alike_components(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Component labels of sets by links of at least that Jaccard similarity; all of them are compared."""
    sizes = np.array([*map(len, sets)])
    both = common_features(sets)
    i, j = np.nonzero(np.triu(both / np.maximum(1, sizes[:, None] + sizes - both) >= least, 1))
    return _unite(np.arange(len(sets)), i, j)


def _compared(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links u, v (u > v) that connect the members of each `group` that are alike: all of a group's are compared.

    A group is cut into parts by its members' hashes, so that no task has more than two of them, and every two parts
    meet in a task; small groups share tasks, and go to the same one if their least members are the same, for groups of
    the same copies overlap. A task gets a set once and returns a star per component, not pairs. A member goes to as
    many tasks as its group has parts.
    """
    sized = members.join(sets.select("class", (F.octet_length("features") / WIDTH).cast("bigint").alias("size")), "class")
    parts = sized.groupBy("group").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("size") / F.lit(PART_FEATURES))).cast("int").alias("parts"),
        F.min("class").alias("leader"))
    packs = max(1, members.count() // PACK)
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = members.join(parts, "group").withColumn("own", own).select(
        "group", "class", "own", "parts", "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    alone = F.col("parts") == 1
    dealt = dealt.select(
        "group", "class", F.when(alone, F.pmod(F.xxhash64("leader"), F.lit(packs))).otherwise(F.col("group")).alias("task"),
        F.when(alone, -1).otherwise(F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j"))
    sent = dealt.groupBy("task", "i", "j", "class").agg(F.collect_list("group").alias("groups"))

    def compare(table: pa.Table) -> pa.Table:
        classes, features = table.column("class").to_numpy(), table.column("features")
        groups = pc.list_flatten(table.column("groups")).to_numpy()
        row = np.repeat(np.arange(len(classes)), pc.list_value_length(table.column("groups")).to_numpy())
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(groups, kind="stable")
        for at in np.split(row[order], np.flatnonzero(np.diff(groups[order])) + 1):
            if len(at) > 1:
                labels = alike_components([unpacked(features[k].as_py()) for k in at.tolist()], least)
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                a, b = classes[at[linked]], classes[at[labels[linked]]]
                u.append(np.maximum(a, b)), v.append(np.minimum(a, b))
        give_back()
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    python_tasks(members)
    return sent.join(sets, "class").groupBy("task", "i", "j").applyInArrow(compare, "u bigint, v bigint").distinct()


def verified_copies(docs: DataFrame, key: str = "doc_id", shingle: int = 5, least: float = 0.8, words: int = 1,
                    budget: int = 4, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """key and component (the smallest key reachable by links) of every row; links are verified similarities.

    A link is a Jaccard similarity of at least `least` between the sets of two texts' shingles. Groups of texts are
    proposed by tries over fingerprints of distinct `words`, one for each of `seeds`, which find scattered edits, and by
    bands of the sets' minima, which find edits in one block too. Within a group all are compared with all, so every
    link that a group holds is found.

    A null or empty text has no shingles and is a copy of others without any. Rows are told apart by their place, so
    repeated rows and null keys keep theirs; among equal keys any may lead. An empty table gives an empty result.
    """
    rows = checkpointed(_copy_rows(docs, key, shingle, words, seeds))
    prints = [f"f{k}" for k in range(len(seeds))]
    classes = checkpointed(rows.groupBy("class").agg(
        F.min("key").alias("first"), F.first("bands").alias("bands"), *(F.first(x).alias(x) for x in prints)))
    groups = classes.select("class", F.explode("bands").alias("group"))
    total = classes.count()
    for k, print_ in enumerate(prints):
        groups = groups.unionByName(_trie_groups(classes, print_, total, budget, k))
    # A class is in a group once, so rows need not be made distinct.
    # Copies of a text share many bands; of groups with the same members, told by their hashes, one is enough.
    same = F.xxhash64("class")
    shared = groups.groupBy("group").agg(F.count("*").alias("n"), F.bit_xor(same).alias("a"), F.bit_xor(
        F.xxhash64(same, F.lit(1))).alias("b")).filter("n > 1").groupBy("n", "a", "b").agg(F.min("group").alias("group"))
    members = checkpointed(groups.join(shared.select("group"), "group", "left_semi"))
    firsts = classes.join(members.select("class").distinct(), "class", "left_semi").select("class", F.col("first").alias("key"))
    texts = docs.select(F.col(key).alias("key"), "text").join(checkpointed(firsts), "key")
    sets = checkpointed(_sets(texts, shingle).dropDuplicates(["class"]))
    roots = components(_compared(members, sets, least)).withColumnsRenamed({"node": "class"})
    named = checkpointed(classes.select("class", "first").join(roots, "class", "left").withColumn(
        "root", F.coalesce("root", "class")))
    least_keys = named.groupBy("root").agg(F.min("first").alias("component"))
    return rows.select("key", "class").join(named.join(least_keys, "root").select("class", "component"), "class").select(
        "key", "component")


def _trie_groups(classes: DataFrame, print_: str, total: int, budget: int, k: int) -> DataFrame:
    """class and group of what a trie brings together: for each star of its links the classes of the star's fingerprints."""
    own = classes.select(F.col(print_).alias("fingerprint"), "class")
    links = near_links(own.select("fingerprint").distinct(), total, budget)
    stars = links.select(F.col("u").alias("fingerprint"), F.col("v").alias("centre"))
    stars = stars.unionByName(own.select("fingerprint", F.col("fingerprint").alias("centre"))).distinct()
    return stars.join(own, "fingerprint").select("class", F.xxhash64(F.lit(k), "centre").alias("group"))
