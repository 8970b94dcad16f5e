"""Ids against the tokenizer on whole texts, and the way back."""

import os

import pytest

from tindra.llm import encoding as E

PATH = f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary is not here")

TEXTS = [
    "Kjøkkensjef på  Sølvsjøen,\n\n  1 234 kr!  ", "it's they'll I'VE don't", "", None, "   ", "\t\r\n", "会社概要：従業員9085名", "👍🏽 é ​­", "a" * 3000 + " b" * 3000, "x\x85y\x1cz　w᠎",
    "\U0001fae8 new sign", "<|endoftext|>", "ab cd  ef", "Открытие склада № 62", "１２３ Ⅷ ²½", "og og og og", "og og og og",
]


def test_ids_and_back(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "uten nøkkel zxqv", "x"), (None, "uten nøkkel", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(4)
    encoder = E.tokenizer(PATH)
    # With hardly any frequent words nearly all take the other way.
    for hot in (0.05, 5e-6):
        ids = E.encode(df, "doc_id", "text", hot_share=hot)
        assert ids.count() == len(rows)
        got = {r.doc_id: r.ids for r in ids.where("doc_id is not null").collect()}
        keyless = sorted(r.ids for r in ids.where("doc_id is null").collect())
        assert keyless == sorted(encoder.encode_ordinary(t) for t in ("uten nøkkel zxqv", "uten nøkkel"))
        assert got == {k: encoder.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in E.decode(ids.where("doc_id is not null").distinct(), "doc_id", "ids").collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}


def test_word_table_has_each_word_once(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a b")], "doc_id bigint, text string")
    rows = {r.word: r.n for r in E.word_table(E.words_of(df, "doc_id", "text"), PATH).collect()}
    assert rows == {"a": 2, " b": 2, " a": 1}
