"""Mixing: shares are met, repeats are kept, and all cases have a result."""

import os

import pytest

from tindra.llm import mixing as X
from tindra.llm.encoding import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="the vocabulary is not here")


def test_shares(spark):
    rows = [(k, f"{'nyheter' if k % 3 else 'stilling'} nummer {k} " + "ord " * (k % 7), "news" if k % 3 else "job", "x") for k in range(900)]
    rows += [(2000 + k, f"anbud {k} frist", "tender", "x") for k in range(12)] + [(3000, None, "news", "x"), (3001, "", "job", "x"), (3002, "uten kilde", None, "x"), (3003, "annet", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate string")
    targets = spark.createDataFrame([("news", 0.5, 2), ("job", 0.35, 2), ("tender", 0.1, 8), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = X.mix(docs, targets)
    assert mixed.count() == len(rows)
    assert {r.copies for r in mixed.where("doc_id >= 3000").collect()} == {0}
    got = {r.source: r for r in X.shares(mixed, targets).collect()}
    for source, share in (("news", 0.5), ("job", 0.35), ("tender", 0.1)):
        assert abs(got[source].actual_share - share / 0.95) < 0.02, got[source]
        assert abs(got[source].expected_share - share / 0.95) < 0.02, got[source]
        assert got[source].most_copies <= {"news": 2, "job": 2, "tender": 8}[source]
    assert got["absent"].used_tokens == 0 and got["absent"].actual_share == 0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("news", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [r.used_tokens for r in X.shares(X.mix(docs, targets), targets).collect()] == [0]


def test_rates_are_fitted_to_the_end(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    n, size = 4, 3000
    k = draw.choice(n, size, p=[0.5, 0.3, 0.15, 0.05])
    tokens = np.ceil(draw.lognormal(5, 1, size)).astype(int)
    score = draw.normal(0, 1, (size, n)) + draw.normal(0, 0.8, (n, n))[k]
    score[np.arange(size), k] += 1
    p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    plan = [("a", 0.2, 2.0), ("b", 0.3, 3.0), ("c", 0.4, 5.0), ("d", 0.1, 4.0)]
    docs = [(i, plan[k[i]][0], int(tokens[i]), p[i].tolist()) for i in range(size)] + [(size, "other", 9, [0.25] * n)]
    fitted, how = X.fit_rates(spark.createDataFrame(docs, "doc_id int, source string, tokens bigint, p array<double>"), plan)
    found = {r.doc_id: r.rate for r in fitted.select("doc_id", "rate").collect()}
    assert len(found) == size + 1 and found[size] == 0 and how["converged"]
    # Brute force: many plain projected steps, all in one place.
    goal, cap = how["goal"], np.array([c for _, _, c in plan])[k]

    def residual(r):
        return r * tokens @ p / goal - 1

    def loss(r):
        return (goal * residual(r) ** 2).sum() / goal.sum() / 2

    scale = (goal / np.bincount(k, tokens, n))[k]
    rate = np.full(size, goal.sum() / tokens.sum())
    for _ in range(5_000):
        rate = np.clip(rate - scale / 3 * (p @ residual(rate)), 0, cap)
    got = np.array([found[i] for i in range(size)])
    assert (got >= 0).all() and (got <= cap + 1e-9).all()
    assert np.allclose(how["residual"], residual(got), atol=1e-6)
    assert loss(got) < loss(rate) + 1e-4, (loss(got), loss(rate))
    assert np.abs(residual(got) - residual(rate)).max() < 0.02


def test_rounds_that_do_not_suffice_are_told(spark):
    docs = [(i, "ab"[i % 2], 10 + i % 7, [0.6, 0.4] if i % 3 else [0.1, 0.9]) for i in range(60)]
    with pytest.warns(UserWarning, match="not converged"):
        _, how = X.fit_rates(spark.createDataFrame(docs, "doc_id int, source string, tokens bigint, p array<double>"), [("a", 0.7, 2.0), ("b", 0.3, 3.0)], rounds=1)
    assert not how["converged"] and how["rounds"] == 1


def test_likelihood_and_label():
    import numpy as np

    texts = ["anbud frist kunngjøring"] * 40 + ["stilling søker lønn"] * 40
    ids, offsets = X.features(texts)
    model = X.Domains(X.fit_softmax(ids, offsets, np.repeat([0, 1], 40), 2))
    p = model.posteriors(["anbud frist kunngjøring", "stilling søker lønn", "anbud frist kunngjøring", "ukjente ord her"], np.array([0, 1, -1, 0]))
    assert p[0, 0] > 0.99 and p[1, 1] > 0.99 and p[2, 0] > 0.9 and p[3, 0] > 0.9 and np.allclose(p.sum(1), 1)
    assert model.posteriors([], np.zeros(0, dtype=int)).shape == (0, 2)
