"""The random field against enumeration, blocks of pages, and held-out accuracy."""

import itertools
import os
import random

import numpy as np
import pytest

from tests.conftest import DATA
from tindra.llm import boilerplate as B
from tindra.llm.crf import LinearChain
from tindra.llm.page_blocks import html_blocks, is_headline, page_context, page_features


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = LinearChain(3)
        m.index = {f"f{k}": k for k in range(6)}
        m.weights, m.steps, m.first = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        x = [[f"f{k}" for k in rng.integers(0, 8, 3)] for _ in range(4)]
        score = lambda y: m.first[y[0]] + sum(m.weights[m.index[f], t].sum() for fs, t in zip(x, y, strict=True) for f in fs if f in m.index) + sum(m.steps[a, b] for a, b in zip(y, y[1:], strict=False))
        assert abs(score(m.decode(x)) - max(score(y) for y in itertools.product(range(3), repeat=4))) < 1e-9
    assert LinearChain(2).decode([]) == []


def test_learns_order():
    x = [[["a"], ["b"], ["a"]], [["b"], ["a"]]] * 10
    y = [[0, 1, 1], [1, 1]] * 10
    m = LinearChain(2).fit(x, y)
    assert m.decode([["a"], ["b"], ["a"]]) == [0, 1, 1] and m.decode([["b"], ["a"]]) == [1, 1]


def test_blocks():
    html = "<html><head><title>A | B</title><script>var x = '<p>no</p>';</script></head>\n<body><nav>\n<li><a href='/x'>X</a></li>\n</nav><main><h1>A</h1>\n<p>One <b>two</b>\nthree &amp; four.\n<p>Five.</main><!-- <p>hid</p> --><table><tr><td>c1</td></tr>\n<tr><td>c2</td></tr></table></body></html>"
    blocks, title = html_blocks(html)
    assert title == "A | B"
    assert [(b.text, b.lines, b.tag) for b in blocks] == [("X", [2], "li"), ("A", [3], "h1"), ("One two three & four.", [4, 5], "p"), ("Five.", [6], "p"), ("c1", [6], "td"), ("c2", [7], "td")]
    assert blocks[0].linked == 1.0 and blocks[4].container == blocks[5].container != blocks[3].container and "main" in blocks[2].ancestors
    assert html_blocks("")[0] == [] and len(html_blocks("<div>" * 3000 + "x")[0]) == 1


def test_headline():
    assert is_headline("Påskeåpent på Råkmark", "", "paskeapent-pa-rakmark-12") and is_headline("A B", "A B | C", "") and not is_headline("Hjem | A B", "A B | C", "x-1")


def test_held_out(spark):
    folder = f"{DATA}/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    pages = B.training_pages(spark.read.parquet(f"{folder}/fetch_results.parquet"), "fetch_id", "url", "body", 300)
    models = B.train(pages[:200])
    right = wrong = missed = 0
    for url, body in pages[200:]:
        blocks, title = html_blocks(body)
        want = B.label_page(blocks)
        blocks = B._renamed(blocks, random.Random(len(body)))
        assert not any("main" in b.ancestors for b in blocks)
        got = models["page"].decode(page_features(blocks, title, url))
        assert got == B._labels(models["page"], blocks, page_context(blocks, title, url))
        for w, g in zip(want, got, strict=True):
            a, b = w in (B.HEADLINE, B.CONTENT), g in (B.HEADLINE, B.CONTENT)
            right, wrong, missed = right + (a and b), wrong + (b and not a), missed + (a and not b)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_kinds(spark):
    models = {k: LinearChain(4) for k in ("page", "text", "lines", "title")}
    assert B.content_lines('{"a": 1}', "", "page", models) == [] and B.content_lines("", "", "lines", models) == [] and B.content_lines(" \n ", "", "title", models) == []
    assert B.train([]).keys() == models.keys()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a\n" * 5000, "x")], "id int, body string, line string")
    B.extract(df, "id", "body", "lines", models).collect()
