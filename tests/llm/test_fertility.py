from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import sentencepiece

from slotwise.llm.fertility import BANDS, BYTE_RANKS, FOLDER, LONG_RUN, PIECES, Vocabularies, base_counts, figures, judge, script_of, within
from slotwise.llm.queries import op3_token_fertility
from tests.llm.helpers import ODD_TEXTS, clashing, empty_documents, odd_documents
from tests.llm.test_oracles import SF_DIR


@pytest.fixture(scope="module")
def vocabularies():
    return Vocabularies(*(open(f"{FOLDER}/{n}", "rb").read() for n in (BYTE_RANKS, PIECES)))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines)), len(inside))


def test_base_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    for text in [*texts, *ODD_TEXTS, "a b c a b c a", "x\nx\n \n \nx", "a\x1cb c d", "# * $%&|<> #"]:
        assert base_counts(text) == brute(text)


def test_fallback_is_what_the_library_spells_in_bytes(spark, vocabularies):
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{PIECES}")
    for text in ["plain", "tab\tand\nline", "日本 😀 ÿ ꙮ", "a\nb\n" * 50, *[t for t in ODD_TEXTS if t and len(t) < 100]]:
        pieces = sp.encode(text, out_type=str)
        spelled = [re.fullmatch("<0x(..)>", p) for p in pieces]
        share = sum(m is not None and chr(int(m[1], 16)) not in "\t\n\v\f\r" for m in spelled) / max(1, len(pieces))
        assert vocabularies.fallback_share(text) == pytest.approx(share)


def test_long_white_space_has_the_same_tokens(vocabularies):
    for space in (" ", "\t", " \n", "\u3000", "\x85", " \t "):
        for n in (LONG_RUN - 1, LONG_RUN, LONG_RUN + 1, 2777):
            gap = space * n
            for text in (gap, f"ab{gap}cd", f"{gap}!x", f"x1{gap}", f"a{gap}'s{gap}日 {gap}", f"\x1c{gap}\x1c"):
                assert vocabularies.byte_tokens(text) == vocabularies.bytes.encode_ordinary(text)


def test_very_long_white_space_is_measured(spark):
    words = " ".join(f"word{i}" for i in range(200))
    texts = [f"{words}{space * (2_000_000 // len(space))}{words} end" for space in (" ", "\t", "\n", " \n")]
    rows = judge(spark.createDataFrame([(t,) for t in texts], "text string")).select("fertility.*").collect()
    assert [r.n_words for r in rows] == [401] * 4 and all(r.chars_per_token is not None or r.base_failed for r in rows)


GOOD = {
    "han": "我们今天去公园散步，天气很好，孩子们在草地上跑来跑去，老人坐在长椅上聊天。 政府宣布了新的经济政策，希望促进就业和消费。",
    "kana": "今日は天気がとても良いので、公園へ散歩に行きました。 子どもたちは楽しそうに遊んでいました。",
    "hangul": "오늘은 날씨가 아주 좋아서 공원에 산책하러 갔습니다. 아이들이 즐겁게 놀고 있었습니다.",
    "indic": "आज मौसम बहुत अच्छा है इसलिए हम पार्क में टहलने गए। बच्चे खुशी से खेल रहे थे।",
    "other": "วันนี้อากาศดีมาก เราจึงไปเดินเล่นที่สวนสาธารณะ เด็กๆ กำลังเล่นอย่างมีความสุข",
    "arabic": "كان الطقس جميلا اليوم فذهبنا إلى الحديقة ولعب الأطفال هناك حتى المساء",
    "greek": "Σήμερα ο καιρός ήταν πολύ καλός και πήγαμε στο πάρκο με τα παιδιά",
    "hebrew": "היום מזג האוויר היה יפה מאוד והלכנו לפארק עם הילדים",
    "cyrillic": "Сегодня погода была очень хорошая и мы пошли в парк с детьми",
}


@pytest.mark.parametrize("script", GOOD)
def test_clean_text_of_a_script_is_inside_its_band(vocabularies, script):
    assert script_of(GOOD[script]) == script
    chars, fallback, _, _ = figures(GOOD[script], vocabularies)
    low, high, most, _ = BANDS[script]
    assert low <= chars <= high and fallback <= most


@pytest.mark.parametrize("script, first, last", [
    ("han", 0x3400, 0x4DB5), ("han", 0x20000, 0x2A6D0), ("kana", 0x31F0, 0x31FF), ("hangul", 0xAC00, 0xD7A3),
    ("indic", 0x0D00, 0x0D7F), ("other", 0x1200, 0x137F), ("greek", 0x1F00, 0x1FFE), ("cyrillic", 0x0500, 0x052F),
    ("arabic", 0x0750, 0x077F), ("hebrew", 0x0591, 0x05BD),
])
def test_spelled_out_text_of_a_script_is_rejected(vocabularies, script, first, last):
    rng = random.Random(first)
    pool = [chr(c) for c in range(first, last + 1)]
    if script != "hangul":
        pool = [c for c in pool if script_of(c) == script or script == "kana"]
    text = " ".join("".join(rng.choices(pool, k=6)) for _ in range(400))
    band = BANDS["other" if script == "kana" else script]  # phonetic extensions lie outside the range of kana
    assert not within(band, *figures(text, vocabularies))


def test_figures(vocabularies):
    tokens = vocabularies.bytes.encode_ordinary("the cat and the dog")
    chars, share, entropy, n = figures("the cat and the dog", vocabularies)
    assert n == len(tokens) and chars == 19 / n and share == 0 and 0 < entropy <= 3
    good = "It was a bright cold day in April, and the clocks were striking thirteen. " * 2
    assert within(BANDS["latin"], *figures(good, vocabularies))
    assert not within(BANDS["latin"], *figures("spam " * 400, vocabularies))
    assert not within(BANDS["latin"], *figures("\x01\x02\x03\x04\x05\x06\x07\x08" * 100, vocabularies))


def test_scripts():
    samples = {"latin": "abc é", "cyrillic": "привет a", "greek": "αβγδ", "han": "汉字汉字", "kana": "ひらがな", "hangul": "한국어",
               "arabic": "السلام", "hebrew": "שלום", "indic": "हिन्दी", "other": "123 !!"}
    assert {k: script_of(v) for k, v in samples.items()} == {k: k for k in samples}


def test_good_documents_are_kept(spark):
    judged = op3_token_fertility(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 1 and not base_failed").count() > 20
    assert judged.filter("quality = 1 and not base_failed and not kept").count() == 0
    assert judged.filter("base_failed and kept").count() == 0


def test_language_bands_go_first(spark):
    docs = spark.createDataFrame([("one two three four five " * 12 + "a b c d e f g h", "xx"), (None, None)], "text string, lang string")
    strict = judge(docs, lang="lang", bands=BANDS | {"xx": (8.0, 9.0, 0.0, 9.0)})
    assert not strict.filter("lang = 'xx'").first().fertility.kept


def test_odd_rows(spark):
    docs = clashing(odd_documents(spark), ["script", "kept"])
    out = judge(docs)
    assert out.count() == docs.count()
    assert out.filter("text is null and (fertility.n_words <> 0 or fertility.kept or not fertility.base_failed)").count() == 0
    assert judge(empty_documents(spark)).count() == 0
