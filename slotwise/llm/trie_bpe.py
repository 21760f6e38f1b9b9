"""Byte-pair encoding with one walk of a trie over distinct words, and decoding.

A text is cut by the vocabulary's added tokens, then by its pattern into words; a word is a string of bytes, encoded by
merges of neighbouring pairs, lowest rank and leftmost first. Which words occur is what a group of texts is reduced to:
its new distinct words form a trie, and the trie is walked depth first. A node is a prefix, and its state is the last
token of the prefix's encoding, from which the rest follows: an encoding less its last token is the encoding of what is
left. A child's state comes from the states on the path to it. Of the tokens that end the longer prefix it is the one
that the merges leave standing beside the last token of the part before it; whether they do is worked out once for each
pair of tokens, by the merges themselves. Since no merge reaches over a border that a later one would have to undo,
neighbours that stand side by side alone do so in any text, and there is one such token.

Sorted words are the trie's nodes in depth-first order: the path to the current node is a stack of states, what a word
has in common with the one before stays on it, and only the bytes after that are new nodes. So a prefix that many words
share is encoded once, and memory is that of the longest word.

Character classes of the pattern are asked from the library, code point by code point, so both cut alike whatever their
Unicode versions. Results equal the library's without special tokens being added, with truncation and padding unused.
Added tokens that stand in a text are encoded as such, as the library does.

Null text has null ids, empty text none. A text of any length is taken whole; its words are worked off in groups. Ids
outside the vocabulary are skipped in decoding, bytes that are no UTF-8 become U+FFFD, as in the library; null ids have
null text. Other columns pass through, but for those named as a result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from slotwise.llm.texts import python_tasks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of texts whose words are looked up at once, and words of one text.
GROUP_CHARS = 1 << 20
GROUP_WORDS = 1 << 18
#: Words a worker remembers, and the longest that it does.
REMEMBERED = 300_000
REMEMBERED_CHARS = 64

ID = np.dtype("<u4")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(1)
def _classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of the code points that the library counts as letters, digits and white space."""
    pages = [[c for c in range(a, a + 0x4000) if not 0xD800 <= c < 0xE000] for a in range(0, 0x110000, 0x4000)]

    def ranges(name: str) -> list[tuple[int, int]]:
        split = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True)
        return [(page[s], page[e - 1]) for page in pages for _, (s, e) in split.pre_tokenize_str("".join(map(chr, page)))]

    return {name: ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}


def word_pattern(last: int = 0x10FFFF) -> str:
    """Words: contractions, letters, digits or other signs after at most one space, and runs of white space.

    For texts without code points above `last` the classes end there, which makes them quick to look up.
    """
    def spelled(ranges: list[tuple[int, int]]) -> str:
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(b, last)))}" for a, b in ranges if a <= last)

    letter, digit, space = map(spelled, _classes().values())
    # The endings that are cut off, and the order of the alternatives.
    return (f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


@lru_cache(1)
def word_patterns() -> tuple[str, str]:
    """For texts of the basic plane, and for any."""
    return word_pattern(0xFFFF), word_pattern()


class Vocabulary:
    """Tokens and merges of a byte-level vocabulary file, and which tokens can stand side by side."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        model, before = data["model"], data["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or odd or data["normalizer"] or before.get("type") != "ByteLevel" or \
                before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        letters = byte_letters()
        as_bytes = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.ids = {as_bytes[token]: i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their neighbours are not supported")
        # An added token may be a token of the vocabulary too; it is then no result of merges.
        self.bytes: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        #: Beginnings of tokens: what ends a prefix is looked for among these.
        self.openings = {b[:k] for b in self.ids for k in range(1, len(b) + 1)}
        self._made = {new: (*pair, rank) for pair, (rank, new) in self.merges.items()}
        late = [t for t, (a, b, rank) in self._made.items() if any(x in self._made and self._made[x][2] >= rank for x in (a, b))]
        if late or len(self._made) < len(self.merges):
            raise ValueError("each merge must make a token of its own from tokens of earlier merges")
        self._whole: dict[int, bool] = {}
        self._ends: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._side_by_side: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """Ids of a short string, by the merges in their order; what everything else here has to agree with."""
        line = [self.single[b] for b in text]
        while len(line) > 1:
            best = min(((*self.merges[pair], k) for k, pair in enumerate(zip(line, line[1:])) if pair in self.merges),
                       key=lambda m: (m[0], m[2]), default=None)
            if best is None:
                break
            line[best[2] : best[2] + 2] = [best[1]]
        return line

    def _border(self, token: int, right: bool) -> list[tuple[int, float]]:
        """What stands at one end of a token while it is made, last first, and the rank of the merge that takes it in."""
        ends = self._ends.get((token, right))
        if ends is None:
            ends, x, taken = [], token, float("inf")
            while True:
                ends.append((x, taken))
                if x not in self._made:
                    break
                a, b, taken = self._made[x]
                x = b if right else a
            self._ends[token, right] = ends
        return ends

    def _crossing(self, left: int, right: int) -> float:
        """The rank of the first merge over the border of two tokens as both are made; infinite if there is none.

        Parts of a token are made before it, so ranks only rise in the course of merging. Two ends that merge at rank r
        meet if neither was taken in before; of equal merges the leftmost comes first, so an equal one on the left
        takes its end away and one on the right comes too late.
        """
        first = float("inf")
        for x, x_taken in self._border(left, True):
            for y, y_taken in self._border(right, False):
                merge = self.merges.get((x, y))
                if merge is not None and merge[0] < x_taken and merge[0] <= y_taken:
                    first = min(first, merge[0])
        return first

    def whole(self, token: int) -> bool:
        """Whether the merges of a token's bytes give the token."""
        known = self._whole.get(token)
        if known is None:
            if token in self._made:
                a, b, rank = self._made[token]
                known = self.whole(a) and self.whole(b) and self._crossing(a, b) == rank
            else:
                known = len(self.bytes[token]) == 1
            self._whole[token] = known
        return known

    def stands(self, before: int, token: int) -> bool:
        """Whether the merges of the two tokens' bytes give just these two; -1 is the beginning of a word.

        The token before is whole.
        """
        pair = before, token
        known = self._side_by_side.get(pair)
        if known is None:
            if len(self._side_by_side) >= 1 << 20:
                self._side_by_side.clear()
            known = self.whole(token) and (before < 0 or self._crossing(before, token) == float("inf"))
            self._side_by_side[pair] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in sorted order, by a depth-first walk of their trie."""
        ids, openings, stands = self.ids, self.openings, self.stands
        # By depth on the path to the current node: the prefix's last token, and how long its longest end is that
        # begins a token.
        last, reach = [-1], [0]
        path = b""
        for word in sorted(words):
            depth, most = 0, min(len(path), len(word))
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], reach[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                size = reach[-1] + 1
                while word[end - size : end] not in openings:
                    size -= 1
                reach.append(size)
                while True:
                    token = ids.get(word[end - size : end])
                    if token is not None and stands(last[end - size], token):
                        break
                    size -= 1
                last.append(token)
            path = word
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end -= len(self.bytes[last[end]])
            found.reverse()
            yield word, found


class Encoder:
    """Texts to ids and back; words are remembered between batches."""

    def __init__(self, file: bytes, patterns: tuple[str, str]):
        self.vocabulary = Vocabulary(file)
        self.basic, self.any = map(re.compile, patterns)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        top = max(self.vocabulary.bytes) + 1
        self.pieces = [self.vocabulary.bytes.get(i, b"") for i in range(top)]

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of each text."""
        out: list[bytes | None] = []
        group: list[str | None] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                out += self._encode_group(group)
                group, chars = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str | None]) -> list[bytes | None]:
        if len(texts) == 1 and texts[0] is not None and len(texts[0]) >= GROUP_CHARS:
            return [b"".join(self._packed([words])[0] for words in self._in_parts(texts[0]))]
        cut = [None if t is None else self._in_words(t) for t in texts]
        packed = iter(self._packed([words for words in cut if words is not None]))
        return [None if words is None else next(packed) for words in cut]

    def _pieces_of(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def _words(self, text: str) -> re.Pattern:
        return self.basic if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else self.any

    def _in_words(self, text: str) -> list[str]:
        words, out = self._words(text), []
        for k, piece in enumerate(self._pieces_of(text)):
            out += [piece] if k % 2 else words.findall(piece)
        return out

    def _in_parts(self, text: str) -> Iterator[list[str]]:
        """The words of a long text, some at a time."""
        words = self._words(text)
        for k, piece in enumerate(self._pieces_of(text)):
            if k % 2:
                yield [piece]
                continue
            found = (m.group() for m in words.finditer(piece))
            while part := list(islice(found, GROUP_WORDS)):
                yield part

    def _packed(self, lines: list[list[str]]) -> list[bytes]:
        """The ids of lists of words. Words of the group that are not known yet go through the trie together."""
        known, added = self.known, self.vocabulary.added
        new = set().union(*lines) - known.keys()
        known |= {w: np.array([added[w]], ID).tobytes() for w in new & added.keys()}
        encoded = self.vocabulary.encode_words([w.encode() for w in new if w not in added])
        known |= {word.decode(): np.array(ids, ID).tobytes() for word, ids in encoded}
        out = [b"".join(map(known.__getitem__, line)) for line in lines]
        if len(known) > REMEMBERED:
            known.clear()
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                known.pop(word, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        kept = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(map(self.pieces.__getitem__, kept.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(file: bytes, patterns: tuple[str, str]) -> Encoder:
    return Encoder(file, patterns)


@lru_cache(2)
def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY,
           packed: bool = False, back: str | None = None) -> DataFrame:
    """`docs` with the ids of its text, an array; `packed` ones are bytes, four for each id, the lowest first.

    With `back`, a column of that name has the text that the ids decode to. The driver reads the vocabulary's file and
    sends it to the workers.
    """
    fixed = python_tasks(docs).broadcast((_file(vocabulary), word_patterns()))

    @F.arrow_udf(f"struct<ids {'binary' if packed else 'array<int>'}, decoded string>")
    def coded(texts: pa.Array) -> pa.Array:
        encoder = _encoder(*fixed.value)
        found = encoder.encode_all(texts.to_pylist())
        decoded = [None if back is None or x is None else encoder.decode(np.frombuffer(x, ID).astype(np.int64)) for x in found]
        if packed:
            ids = pa.array(found, pa.binary())
        else:
            ends = np.cumsum([0, *(len(x or b"") // ID.itemsize for x in found)])
            values = np.frombuffer(b"".join(x for x in found if x), ID).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()),
                                           mask=pa.array([x is None for x in found]))
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], names=["ids", "decoded"])

    coded_docs = docs.withColumn(into, coded(F.col(text)))
    if back is not None:
        coded_docs = coded_docs.withColumn(back, F.col(f"{into}.decoded"))
    return coded_docs.withColumn(into, F.col(f"{into}.ids"))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with the text of its ids, an array of them or packed ones."""
    fixed = python_tasks(docs).broadcast((_file(vocabulary), word_patterns()))
    is_packed = docs.schema[ids].dataType.simpleString() == "binary"

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        encoder = _encoder(*fixed.value)

        def one(row) -> str | None:
            if row is None:
                return None
            numbers = np.frombuffer(row, ID).astype(np.int64) if is_packed else np.array(
                [-1 if i is None else i for i in row], np.int64)
            return encoder.decode(numbers)

        return pa.array(map(one, column.to_pylist()), pa.string())

    return docs.withColumn(into, texts(F.col(ids)))
