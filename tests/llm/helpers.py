"""Small tables with what every operator has to bear."""

from __future__ import annotations

import pytest

LONG = "word and another word. " * 20_000
NO_SPACES = "ab1" * 50_000
ODD_TEXTS = [None, "", " \n\t ", "a", "A.", " ", "\x00\x01", "日本語 テキスト 😀", LONG, NO_SPACES, "x﻿y ▁ \x85", "é" * 3000]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, lang="en"):
    """Documents with ids 0, 1, …; further columns bear the names that operators use inside."""
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_documents(spark):
    """Odd texts, twice each row of the first ones, and rows without id or label."""
    rows = [(i, t, "en" if i % 2 else "de", None, 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[0], rows[3], rows[3], (None, "no id here", None, "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, names):
    """With further columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes odd documents and a few pages as tables in a folder."""
    folder = tmp_path_factory.mktemp("odd")
    odd_documents(spark).write.parquet(f"{folder}/documents.parquet")
    return str(folder)
