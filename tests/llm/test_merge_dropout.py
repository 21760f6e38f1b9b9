from __future__ import annotations

import pytest
import sentencepiece

from slotwise.llm.merge_dropout import _UNITS, MODEL, Encoder, decode, encode, unit_salts
from tests.llm.helpers import ODD_TEXTS, clashing, documents, empty_documents, odd_documents
from tests.llm.test_oracles import SF_DIR

TEXTS = ["The quick brown fox.", " a", "a ", "  a  b\n ﬁ x\t \n\n ", "<0x41> <s> </s> <unk>", "x" * 500 + " the " + "then" * 60,
         "▁a ▁▁ ▁", *[t for t in ODD_TEXTS if t]]


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


def corpus(spark):
    return [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_without_dropout_it_is_the_library(spark, model):
    sp, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(model, 0.0, 0)
    texts = [t for t in [*corpus(spark), *TEXTS] if "▁" not in t]
    for text, ids in zip(texts, encoder.encode_all(texts, [0] * len(texts)), strict=True):
        assert ids.tolist() == sp.encode(text)


def test_round_trip(spark, model):
    encoder = Encoder(model, 0.3, 5)
    texts = [*corpus(spark), *TEXTS]
    for text, ids in zip(texts, encoder.encode_all(texts, list(range(len(texts)))), strict=True):
        assert encoder.pieces.decode(ids.tolist()) == text


def test_agendas_agree(spark, model):
    """Side by side, one by one in a list, and with a heap: the same candidates are skipped."""
    pieces = Encoder(model, 0.0, 0).pieces
    units = list({u for t in corpus(spark)[:80] for u in t.split()})[:3000] + ["é" * 30, "日本語", "a"]
    salts = [hash(u) % 2**64 for u in units]
    for below in (0, 1 << 20, 1 << 23):
        many = pieces.segment_many(units, salts, below)
        assert many == [pieces.segment(u, s, below) for u, s in zip(units, salts, strict=True)]
        for u, s in list(zip(units, salts, strict=True))[::10]:
            ids = pieces.symbols(u)
            assert pieces._by_heap(list(ids), s, below) == pieces._by_list(list(ids), s, below)


def test_everything_skipped_leaves_characters(model):
    encoder = Encoder(model, 1.0, 1)
    (ids,) = encoder.encode_all(["the then"], [0])
    assert ids.tolist() == encoder.pieces.symbols(" the then")


def test_same_seed_same_ids_other_seed_or_document_other_ids(spark):
    text = "The segmentation of these words varies from document to document and from seed to seed. " * 8
    docs = documents(spark, [text, text])
    ids = lambda **o: [r.ids for r in encode(docs, rate=0.2, **o).orderBy("doc_id").collect()]
    one = ids(seed=1)
    assert one == ids(seed=1) and one != ids(seed=2) and one[0] != one[1]
    assert encode(docs.repartition(2), rate=0.2, seed=1).orderBy("doc_id").first().ids == one[0]
    assert len({tuple(r.ids) for r in encode(docs, rate=0.0).collect()}) == 1


def test_small_memory_changes_nothing(spark, model, monkeypatch):
    texts = corpus(spark)[:60]
    whole = [x.tolist() for x in Encoder(model, 0.1, 1).encode_all(texts, list(range(60)))]
    monkeypatch.setattr("slotwise.llm.merge_dropout.CACHED_PATHS", 10)
    monkeypatch.setattr("slotwise.llm.merge_dropout.GROUP_CHARS", 500)
    monkeypatch.setattr("slotwise.llm.merge_dropout.CACHED_CHARS", 3)
    assert [x.tolist() for x in Encoder(model, 0.1, 1).encode_all(texts, list(range(60)))] == whole


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_remembered_paths_are_the_agendas(spark, model, rate):
    """Each occurrence of each unit, as if it were alone."""
    encoder, texts = Encoder(model, rate, 7), [*corpus(spark)[:60], *TEXTS, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 50, "éß日 " * 40]
    for text, ids, key in zip(texts, encoder.encode_all(texts, list(range(len(texts)))), range(len(texts)), strict=True):
        units = _UNITS.findall(" " + text)
        salts = unit_salts(key, len(units), 7).tolist()
        assert ids.astype("<u2").tobytes() == b"".join(
            encoder.pieces.segment(u, s, encoder.below) for u, s in zip(units, salts, strict=True))


def test_a_word_has_as_many_segmentations_as_its_draws_give(model):
    encoder = Encoder(model, 0.1, 1)
    found = encoder.encode_all(["international"] * 5000 + ["international " * 5000], list(range(5001)))
    assert len({x.tobytes() for x in found[:-1]}) > 30
    plain = Encoder(model, 0.0, 1).encode_all(["international"], [0])[0].tolist()
    merges = len("international") - len(plain) + 1
    share = sum(x.tolist() == plain for x in found[:-1]) / 5000
    assert share >= 0.9**merges - 0.03
    # The same word within one text: cut anew at each place.
    assert len(set(bytes(encoder.pieces.segment(" international", s, encoder.below))
                   for s in unit_salts(5000, 5000, 1).tolist())) > 30


def test_ids_that_are_no_whole_text(spark, model):
    pieces = Encoder(model, 0.0, 0).pieces
    half, space = pieces.byte["é".encode()[0]], pieces.char[" "]
    rows = [(0, []), (1, [half]), (2, [-1, 10**6, None]), (3, [pieces.char["a"]]), (4, [space, space]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    assert [r.decoded for r in decode(docs).orderBy("doc_id").collect()] == ["", "\ufffd", "\ufffd" * 3, "a", " ", None]


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["lossless", "decoded"])
    out = encode(docs, check="lossless")
    assert out.filter("lossless").count() == docs.count()
    assert out.filter("(text is null) <> (ids is null)").count() == 0
    assert out.filter("text = '' and size(ids) <> 0").count() == 0
    assert decode(out).filter("not (text <=> decoded)").count() == 0
    assert encode(empty_documents(spark)).count() == 0
