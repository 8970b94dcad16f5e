"""Canonical forms against a plain version that handles one character after the other."""

import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tindra.llm import canonical as C

ALIKE = {a: b for left, right in C.LOOK_ALIKES for a, b in zip(left, right, strict=True)}


def plain(text):
    out = []
    for c in text:
        if any(a <= ord(c) <= b for a, b in C.INVISIBLE):
            continue
        out.append(" " if unicodedata.category(c) == "Zs" else C._plain(c, ALIKE))
    return unicodedata.normalize("NFC", "".join(out))


def forms(texts):
    return C.canonical_array(pa.array(texts, pa.string())).to_pylist()


ALPHABET = "abåøéÅ ñ한ㅎ가각" + "̧̣́̂̊" + "аеοѕＡｂ！ﬁﬆǉ" + "​­ 　᠎️" + "会👍²½\n\t" + "각ÅK"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=12)), max_size=6))
def test_equals_plain(texts):
    assert forms(texts) == [None if t is None else plain(t) for t in texts]


def test_same_and_different():
    same = ["Åpent på fôr – fisk", "Åpent på​ fôr – ﬁsk", "Åреnt рå fôr – ｆｉｓｋ"]
    assert len(set(forms(same))) == 1
    different = ["2014", "2015", "på", "pa", "m²", "m2", "ø", "o", "½", "1/2", "a-b", "a–b", "l", "1", "I", "æ", "ae"]
    assert len(set(forms(different))) == len(different)


def test_long_and_sliced():
    texts = ["å" * 3_000_000, None, "", "é" * 50_000, "a" + "́" * 2000]
    array = pa.array(["x", *texts], pa.string()).slice(1)
    got = C.canonical_array(array).to_pylist()
    assert got[:4] == ["å" * 3_000_000, None, "", "é" * 50_000] and got[4] == plain(texts[4])
    assert C.canonical_array(pa.array([], pa.string())).to_pylist() == []


def test_pairs(spark):
    rows = [(1, "på"), (2, "på"), (3, "på"), (4, "pa"), (5, None), (6, ""), (7, " "), (8, "​"), (9, "рå"), (1, "på")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, form string")
    got = sorted(tuple(r) for r in C.look_alike_pairs(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
