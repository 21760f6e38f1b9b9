"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

Merge-type (BPE) segmentation works on an agenda: of all neighbouring symbols that form a piece, the best-ranked pair
merges next, the leftmost first among equals. With dropout each candidate, when it comes up, is skipped if a keyed
hash of its place and piece falls below the rate; a skipped pair comes up again only if a neighbour changes. The hash
is keyed by the seed, the document and the unit's place in it, so equal words of a text are segmented independently of
each other, and every run, partitioning and machine gives the same ids. Rate 0 gives the library's own segmentation.

Text is cut where no piece can reach across, before spaces and at line ends; each unit is segmented by itself. What is
remembered of units that come again are their agendas, not their outcomes: a path is the order in which candidates come
up after given skips, and the first candidate that an occurrence's hashes skip leads to the next path. An occurrence
without a remembered path works off its own agenda, side by side with others, one pop of each at a time. Both give the
same ids. Memory is bounded: paths are forgotten when full, and a long unit has a heap of its own.

Characters outside the vocabulary become byte pieces, also the space mark itself, so every text decodes to itself.
Null text has null ids, empty text no ids; a null document key counts as 0, and rows of equal keys and texts get equal
ids. Ids need not be those of a whole text to be decoded: null and ids outside the vocabulary become U+FFFD, so do bytes
that are no character, and a space in front is left out if there is one. Columns besides the text pass through, but for
those named as a result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import python_tasks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 1
CACHED_PATHS = 200_000
CACHED_CHARS = 32
LIST_CHARS = 64
GROUP_CHARS = 700_000
SIDE_BY_SIDE = 8192
#: Skips of a path are bits of one number.
PATH_POPS = 64

MARK = "▁"
_UNITS = re.compile(r" *[^ \n]+|\n| +")
_ALL = 0xFFFFFFFFFFFFFFFF
#: Ids and ranks of pieces take 15 bits each, so a candidate (rank, piece) and a pair of ids fit 32 bits.
_BITS = 15
_LOW = (1 << _BITS) - 1
_NONE = (1 << 31) - 1
ID = np.dtype("<u2")
_UNKNOWN = "\ufffd".encode()


class Pieces:
    """A vocabulary as numbers: characters, byte pieces, and what pairs of pieces merge into."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        crossing = [texts[i] for i in normal if "\n" in texts[i] or not re.fullmatch(f"{MARK}*[^{MARK}]*", texts[i])]
        if n > 1 << _BITS:
            raise ValueError(f"more than {1 << _BITS} pieces")
        if crossing:
            raise ValueError(f"pieces reach across words: {crossing[:3]}")
        self.of = {texts[i]: i for i in normal}
        self.byte = [0] * 256
        self.bytes = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.byte[value := int(texts[i][3:5], 16)] = i
                self.bytes[i] = bytes([value])
            elif texts[i] in self.of:
                self.bytes[i] = texts[i].replace(MARK, " ").encode()
        self.char = {t: i for t, i in self.of.items() if len(t) == 1 and t != MARK}
        if MARK in self.of:
            self.char[" "] = self.of[MARK]
        # Ranks follow the scores; pairs of ids, packed in one number, give rank and piece, packed as well.
        ranked = sorted(normal, key=lambda i: -sp.get_score(i))
        self.merge: dict[int, int] = {}
        for rank, i in enumerate(ranked):
            for cut in range(1, len(texts[i])):
                a, b = self.of.get(texts[i][:cut]), self.of.get(texts[i][cut:])
                if a is not None and b is not None:
                    self.merge[a << _BITS | b] = rank << _BITS | i
        self._file()
        self.point = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.point[ord(c)] = i

    def symbols(self, unit: str) -> list[int]:
        out, char = [], self.char
        for c in unit:
            i = char.get(c)
            if i is None:
                out += [self.byte[b] for b in c.encode()]
            else:
                out.append(i)
        return out

    def segment(self, unit: str, salt: int, below: int) -> bytes:
        """Ids of a unit, two bytes each. `below` is the rate in 2**24ths; `salt` keys its hashes."""
        ids = self.symbols(unit)
        ids = self._by_list(ids, salt, below) if len(ids) <= LIST_CHARS else self._by_heap(ids, salt, below)
        return np.array(ids, ID).tobytes()

    def _by_list(self, ids: list[int], salt: int, below: int) -> list[int]:
        get = self.merge.get
        places = list(range(len(ids)))
        ranks = [get(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            if below and _skipped(salt, places[i], best, below):
                ranks[i] = _NONE
                continue
            ids[i] = new = best & _LOW
            del ids[i + 1], places[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _BITS | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << _BITS | ids[i + 1], _NONE)
        return ids

    def _by_heap(self, ids: list[int], salt: int, below: int) -> list[int]:
        get, n = self.merge.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := get(ids[i] << _BITS | ids[j])) is not None:
                heapq.heappush(agenda, (found, i, ids[i], ids[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            found, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            if below and _skipped(salt, i, found, below):
                continue
            ids[i], ids[j] = found & _LOW, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])
        return [x for x in ids if x >= 0]

    def _file(self) -> None:
        """Pairs in an open table of which an eighth is used at most; a pair lies at its place or behind it."""
        bits = (len(self.merge) * 8).bit_length()
        self.table = np.full(1 << bits, -1, np.int32)
        self.merged = np.full(1 << bits, _NONE, np.int32)
        self.table_shift, self.table_end = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        keys, values = np.array(list(self.merge), np.int64), np.array(list(self.merge.values()), np.int32)
        place = self._place(keys)
        while len(keys):
            first = np.unique(place, return_index=True)[1]
            first = first[self.table[place[first]] < 0]
            self.table[place[first]], self.merged[place[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, place = keys[rest], values[rest], (place[rest] + 1) & self.table_end

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.table_shift).astype(np.int64)

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and piece of neighbouring symbols, or _NONE; -1 is no symbol."""
        shape = a.shape
        key = np.where(b < 0, _NONE, (a & _LOW) << np.int32(_BITS) | b & _LOW).ravel()
        place = self._place(key)
        held = self.table[place]
        out = np.where(held == key, self.merged[place], np.int32(_NONE))
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            place[rest] = (place[rest] + 1) & self.table_end
            held = self.table[place[rest]]
            found = held == key[rest]
            out[rest[found]] = self.merged[place[rest[found]]]
            rest = rest[~found & (held >= 0)]
        return out.reshape(shape)

    def segment_many(self, units: list[str], salts: list[int], below: int) -> list[bytes]:
        """`segment` of many units, whose agendas are worked off side by side."""
        out = [b""] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = self.point[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        plain = (np.minimum.reduceat(points, firsts) >= 0) & (lengths <= LIST_CHARS) if len(units) else lengths > 0
        for u in np.flatnonzero(~plain).tolist():
            out[u] = self.segment(units[u], salts[u], below)
        order = np.flatnonzero(plain)
        order = order[np.argsort(lengths[order], kind="stable")]
        keys = np.array(salts, np.uint64)
        for at in range(0, len(order), SIDE_BY_SIDE):
            rows = order[at : at + SIDE_BY_SIDE]
            self._side_by_side(rows, points, firsts[rows], lengths[rows], keys[rows], below, out)
        return out

    def paths(self, units: list[str], skips: list[int]) -> tuple[list[bytes], list[np.ndarray]]:
        """Ids of units whose candidates are skipped at the pops that the bits of `skips` name, no others, and how their
        candidates come up: of each pop, in order, what its hash is made of besides the salt."""
        symbols = [self.symbols(u) for u in units]
        lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
        points = np.fromiter(chain.from_iterable(symbols), np.int32, int(lengths.sum()))
        firsts, masks = np.cumsum(lengths) - lengths, np.array(skips, np.uint64)
        out, pops = [b""] * len(units), [np.zeros(0, np.uint64)] * len(units)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), SIDE_BY_SIDE):
            rows = order[at : at + SIDE_BY_SIDE]
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            self._side_by_side(rows, points, firsts[rows], lengths[rows], masks[rows], -1, out, seen)
            if not seen:
                continue
            of, what = np.concatenate([r for r, _ in seen]), np.concatenate([w for _, w in seen])
            sorted_ = np.argsort(of, kind="stable")
            of, what = of[sorted_], what[sorted_]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for row, part in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(what, cuts), strict=True):
                pops[row] = part
        return out, pops

    def _side_by_side(self, rows: np.ndarray, points: np.ndarray, firsts: np.ndarray, lengths: np.ndarray,
                      salts: np.ndarray, below: int, out: list[bytes],
                      seen: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        # With `seen`, `salts` are the skips of paths, and every pop is noted.
        # A symbol is its place in the unit and its id in one number, -1 behind the last one.
        width = int(lengths.max())
        column = np.arange(width, dtype=np.int32)
        points = points[np.minimum(firsts[:, None] + column, len(points) - 1)]
        symbols = np.full((len(rows), width + 1), -1, np.int32)
        np.copyto(symbols[:, :-1], column << _BITS | points, where=column < lengths[:, None])
        ranks = np.hstack((
            self._candidates(symbols[:, :-1], symbols[:, 1:]), np.full((len(rows), 1), _NONE, np.int32)))
        pop = 0
        while True:
            each = np.arange(len(rows))
            i = ranks.argmin(axis=1)
            best = ranks[each, i]
            done = best == _NONE
            if done.sum() * 4 >= len(rows):
                left = symbols[done]
                inside = left >= 0
                flat = (left[inside] & _LOW).astype(ID).tobytes()
                ends = (np.cumsum(inside.sum(axis=1)) * ID.itemsize).tolist()
                for r, start, end in zip(rows[done].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[r] = flat[start:end]
                live = ~done
                if not live.any():
                    return
                rows, symbols, ranks, salts, i, best, done = (
                    x[live] for x in (rows, symbols, ranks, salts, i, best, done))
                each = np.arange(len(rows))
            own = symbols[each, i]
            if seen is not None:
                seen.append((rows[~done], _mark(own[~done] >> _BITS, best[~done])))
            if below:
                if seen is None:
                    skipped = ~done & (_drawn(salts ^ _mark(own >> _BITS, best)) < below)
                elif pop < PATH_POPS:
                    skipped = ~done & (salts >> np.uint64(pop) & np.uint64(1) > 0)
                else:
                    skipped = np.zeros(len(rows), bool)
                ranks[each[skipped], i[skipped]] = _NONE
                merging = ~(done | skipped)
            else:
                merging = ~done
            pop += 1
            # The left symbol of each merging pair becomes the piece, the right one goes, what follows moves up.
            symbols[each[merging], i[merging]] = (own[merging] & ~np.int32(_LOW)) | (best[merging] & _LOW)
            behind = np.where(merging, i, width)[:, None]
            symbols[:, 1:-1] = np.where(column[1:] > behind, symbols[:, 2:], symbols[:, 1:-1])
            ranks[:, :-1] = np.where(column >= behind, ranks[:, 1:], ranks[:, :-1])
            each, i = each[merging], i[merging]
            new = symbols[each, i]
            ranks[each, i] = self._candidates(new, symbols[each, i + 1])
            left = np.flatnonzero(i > 0)
            each, i = each[left], i[left] - 1
            ranks[each, i] = self._candidates(symbols[each, i], new[left])

    def decode(self, ids: list[int | None]) -> str:
        """The text, without the space that encoding puts in front."""
        n = len(self.bytes)
        data = b"".join([self.bytes[i] if i is not None and 0 <= i < n else _UNKNOWN for i in ids])
        return data.removeprefix(b" ").decode(errors="replace")


def _skipped(salt: int, place: int, candidate: int, below: int) -> bool:
    mixed = (salt ^ place * 0x9E3779B97F4A7C15 ^ candidate * 0xC2B2AE3D27D4EB4F) & _ALL
    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & _ALL
    return (mixed >> 40) < below


def _mark(places: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """What a candidate's hash is made of, besides the salt."""
    return (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            ^ candidates.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _drawn(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(40)


def unit_salts(key: int, n: int, seed: int) -> np.ndarray:
    """Keys of the hashes of a document's first `n` units."""
    start = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed)
    mixed = np.uint64(start) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xA0761D6478BD642F)
    return mixed ^ mixed >> np.uint64(31)


class Paths:
    """Remembered paths, by number. Path r of a unit is the one without skips; others begin where a skip leaves one."""

    def __init__(self) -> None:
        self.roots: dict[str, int] = {}
        self.after: dict[int, int] = {}
        #: Units, and paths times PATH_POPS plus pop, that came up once without being remembered.
        self.once: set[str | int] = set()
        self.units: list[str] = []
        self.skips: list[int] = []
        self.ids: list[bytes] = []
        self.tables: list[np.ndarray] = []
        self.marks = self.first = self.size = self.pop = np.zeros(0, np.int64)

    def add(self, pieces: Pieces, units: list[str], skips: list[int]) -> range:
        """Numbers of new paths. A path's own candidates are those after its last skip."""
        ids, pops = pieces.paths(units, skips)
        start, begin = len(self.units), [s.bit_length() for s in skips]
        own = [p[b:] for p, b in zip(pops, begin, strict=True)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        self.first = np.concatenate((self.first, len(self.marks) + np.cumsum(size) - size))
        self.size, self.pop = np.concatenate((self.size, size)), np.concatenate((self.pop, np.array(begin, np.int64)))
        self.marks = np.concatenate((self.marks.astype(np.uint64), *own))
        self.units += units
        self.skips += skips
        self.ids += ids
        return range(start, len(self.units))


class Encoder:
    """Encodes texts of a process, with a bounded memory of paths."""

    def __init__(self, model: bytes, rate: float, seed: int):
        self.pieces, self.below, self.seed = Pieces(model), round(rate * (1 << 24)), seed
        self.paths = Paths()

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray | None]:
        """Ids of texts, some `GROUP_CHARS` of text at a time; a longer text is a group of its own."""
        out: list[np.ndarray | None] = []
        group: list[tuple[list[str], int] | None] = []
        held = 0
        for text, key in zip(texts, keys, strict=True):
            group.append(None if text is None else (_UNITS.findall(" " + text) if text else [], key))
            held += len(text or "")
            if held >= GROUP_CHARS:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def _group(self, group: list[tuple[list[str], int] | None]) -> list[np.ndarray | None]:
        units = [u for found in group if found for u in found[0]]
        salts = [unit_salts(key, len(own), self.seed) for own, key in filter(None, group)]
        parts = self._segments(units, np.concatenate(salts) if salts else np.zeros(0, np.uint64))
        out, at = [], 0
        for found in group:
            if found is None:
                out.append(None)
                continue
            end = at + len(found[0])
            out.append(np.frombuffer(b"".join(parts[at:end]), ID).astype(np.int32))
            at = end
        return out

    def _segments(self, units: list[str], salts: np.ndarray) -> list[bytes]:
        """Ids of occurrences of units, each under its own salt."""
        if len(self.paths.units) >= CACHED_PATHS or len(self.paths.once) >= 4 * CACHED_PATHS:
            self.paths = Paths()
        paths = self.paths
        new = Counter(u for u in units if u not in paths.roots and len(u) <= CACHED_CHARS)
        again = [u for u, n in new.items() if self._comes_again(u, n) and (
            len(u) * 4 <= LIST_CHARS or len(self.pieces.symbols(u)) <= LIST_CHARS)]
        paths.roots.update(zip(again, paths.add(self.pieces, again, [0] * len(again)), strict=True))
        path = np.fromiter((paths.roots.get(u, -1) for u in units), np.int64, len(units))
        active = np.flatnonzero(path >= 0) if self.below else np.zeros(0, np.int64)
        while len(active):
            # The first candidate of each path that the occurrence's hashes skip.
            own = path[active]
            size = paths.size[own]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(paths.first[own] - (ends - size), size)
            hit = np.flatnonzero(_drawn(np.repeat(salts[active], size) ^ paths.marks[place]) < self.below)
            of = np.searchsorted(ends, hit, "right")
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            hit, of = hit[first], of[first]
            active, own = active[of], own[of]
            path[active] = self._next(own, hit - (ends - size)[of] + paths.pop[own])
            active = active[path[active] >= 0]
        rest = np.flatnonzero(path < 0).tolist()
        worked = self.pieces.segment_many([units[i] for i in rest], salts[rest].tolist(), self.below)
        ids = paths.ids
        out = [ids[p] if p >= 0 else b"" for p in path.tolist()]
        for i, found in zip(rest, worked, strict=True):
            out[i] = found
        return out

    def _next(self, own: np.ndarray, pop: np.ndarray) -> np.ndarray:
        """Paths that follow paths after a skip at a pop; -1 for those that are not remembered."""
        paths = self.paths
        keys, where, times = np.unique(
            np.where(pop < PATH_POPS, own * PATH_POPS + pop, -1), return_inverse=True, return_counts=True)
        keys = keys.tolist()
        again = [k for k, n in zip(keys, times.tolist(), strict=True)
                 if k >= 0 and k not in paths.after and self._comes_again(k, n)]
        from_, bits = [k // PATH_POPS for k in again], [1 << k % PATH_POPS for k in again]
        added = paths.add(self.pieces, [paths.units[p] for p in from_], [paths.skips[p] | b for p, b in zip(from_, bits, strict=True)])
        paths.after.update(zip(again, added, strict=True))
        return np.fromiter((paths.after.get(k, -1) for k in keys), np.int64, len(keys))[where]

    def _comes_again(self, what: str | int, times: int) -> bool:
        once = self.paths.once
        if times > 1 or what in once:
            once.discard(what)
            return True
        once.add(what)
        return False


@lru_cache(maxsize=2)
def _encoder(model: bytes, rate: float, seed: int) -> Encoder:
    return Encoder(model, rate, seed)


def _number(key: Column) -> Column:
    return F.coalesce(F.xxhash64(key), F.lit(0))


def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _list_array(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int32)
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
    values = [r for r in rows if r is not None]
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()),
        mask=pa.array([r is None for r in rows]))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "ids", model: str = MODEL,
           rate: float = RATE, seed: int = SEED, check: str | None = None) -> DataFrame:
    """`docs` with the ids of its text; with `check`, a column of that name tells whether they decode to the text.

    The model file is read once, by the driver, and sent to the workers.
    """
    fixed = python_tasks(docs).broadcast(_file(model))

    @F.arrow_udf("struct<ids array<int>, lossless boolean>")
    def coded(texts: pa.Array, keys: pa.Array) -> pa.Array:
        encoder = _encoder(fixed.value, rate, seed)
        plain = texts.to_pylist()
        ids = encoder.encode_all(plain, keys.to_pylist())
        same = [None if check is None else (i is None if t is None else encoder.pieces.decode(i.tolist()) == t)
                for t, i in zip(plain, ids, strict=True)]
        return pa.StructArray.from_arrays([_list_array(ids), pa.array(same, pa.bool_())], names=["ids", "lossless"])

    found = docs.withColumn(into, coded(F.col(text), _number(F.col(key))))
    if check is not None:
        found = found.withColumn(check, F.col(f"{into}.lossless"))
    return found.withColumn(into, F.col(f"{into}.ids"))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """`docs` with the text of its ids; null ids have null text."""
    fixed = python_tasks(docs).broadcast(_file(model))

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        pieces = _encoder(fixed.value, 0.0, 0).pieces
        return pa.array([None if x is None else pieces.decode(x) for x in column.to_pylist()], pa.string())

    return docs.withColumn(into, texts(F.col(ids)))
