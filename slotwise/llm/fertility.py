"""Quality rules from tokeniser fertility: how well public vocabularies fit a text.

Three figures of a whole text are held against bands of its script (or of its language, where the caller gives one):
characters per token and token entropy under a byte-level vocabulary for many languages, and the share of a piece
vocabulary's tokens that spell out bytes, because it has no piece for the character. Text that a vocabulary cannot
compress, or that repeats a few tokens, falls outside.
Entropy is bounded by the number of tokens, so its lower edge is lowered for short texts.

Base counts (words, characters in words, symbols, repeated lines, repeated three-word windows) come from the same
pass; a text that fails the base rule is not measured further. Rows stay in the task that reads them: no shuffle.

White space of any length is one piece of the byte-level vocabulary, but for the last character before a word. Long
runs are cut there and encoded by themselves, since the pattern's look-ahead does not bear them; the tokens are the same.

Null and empty texts have zero counts, fail the base rule and have null figures. Every text is measured whole.
Repeated rows are judged each for itself. Columns besides the text pass through,
but for one named as the result.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from slotwise.llm.texts import python_tasks

FOLDER = "/opt/tokenizers"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: How a byte-level vocabulary of this family cuts text before merging: a fixed value.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
#: Lowest and highest characters per token, highest byte-fallback share, lowest entropy in bits.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.3, 9.0, 0.2, 5.4),
    "cyrillic": (0.9, 9.0, 0.3, 5.4),
    "greek": (0.7, 9.0, 0.6, 5.0),
    "arabic": (0.7, 9.0, 0.6, 5.0),
    "hebrew": (0.6, 9.0, 0.6, 5.0),
    "indic": (0.5, 9.0, 0.7, 4.5),
    "han": (0.5, 5.0, 0.7, 5.0),
    "kana": (0.5, 5.0, 0.7, 5.0),
    "hangul": (0.6, 5.0, 0.7, 5.0),
    "other": (0.4, 9.0, 0.8, 4.0),
}
#: A text of n tokens need not reach more than this share of log2(n).
ENTROPY_SHARE = 0.75
#: First code points of ranges and the script that starts there: fixed values of Unicode.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "other"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
_FIRST = np.array([first for first, _ in RANGES])
_SPACES = " \t\n\v\f\r"
SPACE_BYTES = {f"<0x{ord(c):02X}>" for c in _SPACES if c != " "}
#: White space as the pattern sees it, and from how many characters on a run is encoded by itself.
LONG_RUN = 1_000
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Vocabularies:
    def __init__(self, ranks: bytes, pieces: bytes):
        pairs = (line.split() for line in ranks.splitlines())
        self.bytes = tiktoken.Encoding(
            "bytes", pat_str=CUT, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        ids = range(self.pieces.get_piece_size())
        known = [p for p in map(self.pieces.id_to_piece, ids) if len(p) == 1]
        #: Characters without a piece: without any of them, no token is a byte.
        self.unknown = re.compile("[^" + "".join(map(re.escape, [*known, *_SPACES])) + "]")
        self.is_byte = np.array([self.pieces.is_byte(i) and self.pieces.id_to_piece(i) not in SPACE_BYTES for i in ids])

    def byte_tokens(self, text: str) -> list[int]:
        """Ids under the byte-level vocabulary."""
        ids: list[int] = []
        done = 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bytes.encode_ordinary(text[done : run.start()])
            ids += self.bytes._encode_single_piece(text[run.start() : end])
            done = end
        return ids + self.bytes.encode_ordinary(text[done:])

    def fallback_share(self, text: str) -> float:
        """Byte tokens, but for those of line ends and tabs, among the tokens of the piece vocabulary."""
        ids = self.pieces.encode(text) if self.unknown.search(text) else []
        return float(self.is_byte[ids].mean()) if ids else 0.0


@lru_cache(maxsize=2)
def _vocabularies(ranks: bytes, pieces: bytes) -> Vocabularies:
    return Vocabularies(ranks, pieces)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that stand in the text twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    pair = ids[:-1] * len(words) + ids[1:]
    if len(words) < 2_000_000:
        window = pair[:-1] * len(words) + ids[2:]
    else:  # three places no longer fit 64 bits; number the pairs first
        window = np.unique(pair, return_inverse=True)[1][:-1] * len(words) + ids[2:]
    order = np.argsort(window)
    same = np.diff(window[order]) == 0
    again = np.zeros(n, bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[k : k + n] |= again
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            repeated += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), repeated,
            repeated_words(words))


def script_of(text: str) -> str:
    """The script of most letters; the first in order of RANGES if several have as many."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = points < 0x80
    ascii_letters = int((((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A) & low).sum())
    counts = dict.fromkeys(BANDS, 0) | {"latin": ascii_letters}
    rest = points[~low]
    for slot, times in zip(*np.unique(np.searchsorted(_FIRST, rest, side="right") - 1, return_counts=True)):
        counts[RANGES[slot][1]] += int(times)
    return max(counts, key=counts.__getitem__) if any(counts.values()) else "other"


def figures(text: str, vocabularies: Vocabularies) -> tuple[float, float, float, int]:
    """Characters per token, byte-fallback share, token entropy and number of tokens."""
    tokens = vocabularies.byte_tokens(text)
    share = np.fromiter(Counter(tokens).values(), np.int64) / len(tokens)
    return (len(text) / len(tokens), vocabularies.fallback_share(text),
            float(-(share * np.log2(share)).sum()), len(tokens))


def within(band: tuple[float, float, float, float], chars: float, fallback: float, entropy: float, n: int) -> bool:
    low, high, most, least = band
    return low <= chars <= high and fallback <= most and entropy >= min(least, ENTROPY_SHARE * np.log2(max(n, 2)))


_MEASURED = StructType([
    *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("script", StringType()),
    StructField("chars_per_token", DoubleType()), StructField("fallback_share", DoubleType()),
    StructField("token_entropy", DoubleType()),
])


def judge(docs: DataFrame, text: str = "text", lang: str | None = None, into: str = "fertility",
          bands: dict[str, tuple[float, float, float, float]] = BANDS, folder: str = FOLDER) -> DataFrame:
    """`docs` with a struct of base counts, figures and the verdict `kept`.

    `bands` may name languages too; with `lang` given, a language's band goes before its script's.
    """
    def content(name: str) -> bytes:
        with open(f"{folder}/{name}", "rb") as file:
            return file.read()

    fixed = python_tasks(docs).broadcast((content(BYTE_RANKS), content(PIECES)))

    def one(value: str | None, language: str | None) -> tuple:
        counts = base_counts(value)
        failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
        if failed:
            return *counts, True, False, None, None, None, None
        script = script_of(value)
        *measured, n = figures(value, _vocabularies(*fixed.value))
        return *counts, False, bool(within(bands.get(language) or bands[script], *measured, n)), script, *measured

    @F.pandas_udf(_MEASURED)
    def measure(values: pd.Series, languages: pd.Series) -> pd.DataFrame:
        rows = [one(v, g) for v, g in zip(values, languages, strict=True)]
        return pd.DataFrame(rows, columns=_MEASURED.fieldNames())

    return docs.withColumn(into, measure(text, F.col(lang) if lang else F.lit(None).cast("string")))
