"""Language identification by compression: the language whose dictionary compresses a text best is its language.

Each language gets a zstandard raw-content dictionary, made of normalised text of a few labelled documents. A text is
cut into blocks, each block is compressed with every dictionary by itself, and sizes add up over the whole text; small
blocks keep the text's own history from drowning the dictionaries. A narrow margin between the best two is rejected.

Learning takes a bounded sample, which is all that the driver sees: per language at most one labelled document for
each of `SAMPLE_BUCKETS` hash buckets (the one with the smallest hash), of which `SAMPLE_CHARS` characters, cut to
`DICTIONARY_BYTES`. Buckets are reduced in the tasks that read them, so no language meets in one task. Prediction
needs the text only and runs where the text is read, without a shuffle.

Null texts, and those without a letter, are `und` with score 0 and not accepted. Ties go to the first language by
name. Rows with a null or blank label or text teach nothing; without any teacher every text is `und`. Repeated rows
fall into one bucket and teach once. Columns besides the named ones pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from slotwise.llm.texts import python_tasks

SAMPLE_BUCKETS = 96
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 1 << 15
BLOCK_BYTES = 1024
LEVEL = 6
#: A text is accepted if the second-best language needs this share of bytes more than the best.
MIN_MARGIN = 0.004

SPACE = " ".encode("utf-16-le")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """Lower-case words between single spaces, so that case, digits and signs tell nothing.

    In UTF-16, for zstandard finds matches of three bytes or more: here these are two letters, not three.
    """
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-16-le", "surrogatepass")


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language of `labelled`. Two passes: one over keys and labels, one for the chosen texts."""
    digest = F.xxhash64(key)
    usable = labelled.filter(F.col(lang).isNotNull() & (F.trim(lang) != "") & F.col(key).isNotNull())
    chosen = (
        usable.filter(F.col(text).isNotNull())
        .groupBy(F.col(lang).alias("lang"), F.pmod(digest, F.lit(SAMPLE_BUCKETS)).alias("bucket"))
        .agg(F.min_by(key, digest).alias("key"))
        .collect()
    )
    keys = sorted({row.key for row in chosen})
    if not keys:
        return {}
    head = F.substring(text, 1, SAMPLE_CHARS)
    teachers = (
        usable.filter(F.col(key).isin(keys)).groupBy(F.col(key).alias("key"), F.col(lang).alias("lang"))
        .agg(F.min(head).alias("text")).collect()
    )
    wanted = {(row.key, row.lang) for row in chosen}
    dictionaries: dict[str, bytes] = {}
    for row in sorted(teachers, key=lambda r: (r.lang, r.key)):
        if row.text and (row.key, row.lang) in wanted:
            dictionaries[row.lang] = dictionaries.get(row.lang, b"") + normalise(row.text) + SPACE
    return {lang: spread(data) for lang, data in dictionaries.items() if len(data) > len(SPACE)}


def spread(data: bytes) -> bytes:
    """At most DICTIONARY_BYTES, taken in even pieces over the whole sample."""
    if len(data) <= DICTIONARY_BYTES:
        return data
    pieces = 64
    step, size = len(data) // pieces // 2 * 2, DICTIONARY_BYTES // pieces
    return b"".join(data[i * step : i * step + size] for i in range(pieces))


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in dictionaries:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(
            dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score and margin of a whole text. The score is the best language's share when sizes become odds."""
    data = normalise(text) if text and any(map(str.isalpha, text)) else b""
    if not data or not dictionaries:
        return "und", 0.0, 0.0
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(dictionaries))
    best, lang = sizes[0]
    margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    # A difference of 1 % of the size halves the odds of a language.
    odds = sum(2.0 ** (-100.0 * (size - best) / best) for size, _ in sizes)
    return lang, 1.0 / odds, margin


_RESULT = StructType([
    StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()),
])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN,
             into: str = "language") -> DataFrame:
    """`docs` with a struct of lang_pred, score, margin and accepted; a column of its name is replaced."""
    fixed = python_tasks(docs).broadcast(tuple(sorted(dictionaries.items())))

    @F.pandas_udf(_RESULT)
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, fixed.value) for t in texts], columns=["lang_pred", "score", "margin"])

    accepted: Column = (F.col(f"{into}.lang_pred") != "und") & (F.col(f"{into}.margin") >= min_margin)
    return docs.withColumn(into, guess(text)).withColumn(into, F.col(into).withField("accepted", accepted))
