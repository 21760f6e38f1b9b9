from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slotwise.llm.compression_langid import classify, identify, learn, normalise
from slotwise.llm.queries import op2_compression_language
from tests.llm.helpers import clashing, documents, empty_documents, odd_documents
from tests.llm.test_oracles import SF_DIR


@pytest.fixture(scope="module")
def judged(spark):
    lang = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    return op2_compression_language(spark, SF_DIR).join(lang, "doc_id").cache()


def test_held_out_accuracy(spark, judged):
    test = judged.filter("held_out and length(text) > 200")
    assert test.count() > 30
    assert test.filter("lang = lang_pred").count() >= 0.97 * test.count()
    assert judged.filter("score < 0 or score > 1 or score is null").count() == 0


def test_prediction_needs_the_text_only(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = learn(docs)
    one = identify(docs, known).select("text", "language.lang_pred")
    two = identify(docs.withColumns({"lang": F.lit("xx"), "doc_id": F.lit(1), "source": F.lit(None)}), known)
    assert one.subtract(two.select("text", "language.lang_pred")).count() == 0


def test_smallest_encoding_wins():
    known = (("a", normalise("alpha beta gamma delta " * 50)), ("b", normalise("lorem ipsum dolor sit amet " * 50)))
    lang, score, margin = classify("Alpha BETA, gamma; delta", known)
    assert lang == "a" and score > 0.5 and margin > 0
    assert classify("...", known) == classify(None, known) == classify("12 ² 3", known) == ("und", 0.0, 0.0)
    assert classify("alpha", ()) == ("und", 0.0, 0.0)


def test_narrow_margins_are_rejected(spark):
    known = {"a": normalise("alpha beta " * 50), "b": normalise("alpha beta " * 50)}
    row = identify(documents(spark, ["alpha beta"]), known).select("language.*").first()
    assert row.lang_pred == "a" and row.margin == 0 and not row.accepted


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["bucket", "key", "score"])
    known = learn(docs)
    out = identify(docs, known)
    assert out.count() == docs.count()
    assert {r.lang_pred for r in out.filter("text is null or text = ''").select("language.lang_pred").collect()} == {"und"}
    assert learn(empty_documents(spark)) == {} == learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert identify(docs, {}).filter("language.accepted").count() == 0
    assert identify(empty_documents(spark), known).count() == 0
