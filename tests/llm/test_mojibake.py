"""Garbled text: segments against brute force, restoration of known damage."""

import itertools
import random

import numpy as np
import pytest

from tindra.llm import mojibake as M

CLEAN = ["Kjøkkensjef på Sølvsjøen", "Årsmøtet valgte nytt styre", "Lærlingene våre består prøven", "Vær varm: ½ pris på fôrflåter", "Ελληνικό λάδι på Hummeleidet", "Sæsongens første levering – av laks", "Måler partikler ned til 83 µm", "NOVA FÁBRICA EM SÃO BRIVO"]


@pytest.fixture(scope="module")
def model():
    counts = {}
    for t in CLEAN * 50:
        s = M.symbols("\n" + t + "\n")
        for p in (s[:-1] << 21 | s[1:]).tolist():
            counts[p] = counts.get(p, 0) + 1
    total = sum(counts.values())
    return M.PairModel(np.array(list(counts)), np.array([n / total for n in counts.values()]))


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then left and right of it."""
    best = max(((sum(scores[a:b]), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    # Of equal sums the shortest and leftmost.
    a, b = min(((b - a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sum(scores[a:b]) == best[0]))[1:]
    return [*brute_segments(scores[:a]), (a, b), *((x + b, y + b) for x, y in brute_segments(scores[b:]))]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-5.03, -3.11, -1.07, 2.01, 4.13, 1.29]) + rng.random() / 100 for _ in range(rng.randrange(0, 9))]
        assert M.segments(scores) == brute_segments(scores)


@pytest.mark.parametrize("read_as", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r"])
def test_restores_utf8(model, read_as):
    for clean in CLEAN[:4]:
        garbled = clean.encode("utf-8").decode(read_as, "replace")
        if "�" not in garbled:
            assert M.restore(garbled, model)[0] == clean


def test_restores_twice_garbled_and_swapped(model):
    twice = CLEAN[0].encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252")
    assert M.restore(twice, model)[0] == CLEAN[0]
    assert M.restore("Kj¿kkensjef pŒ S¿lvsj¿en", model)[0] == CLEAN[0]
    assert M.restore("Kj+APg-kkensjef p+AOU S+APg-lvsj+APg-en", model)[0] == CLEAN[0]


def test_leaves_clean_text(model):
    for clean, extra in itertools.product(CLEAN, ("", " 12")):
        assert M.restore(clean + extra, model) == (clean + extra, [])
    assert M.restore("", model) == ("", [])


def test_rows(spark, model):
    rows = [("1", CLEAN[0]), ("1", CLEAN[0]), ("2", "KjÃ¸kkensjef"), ("3", "M�belsnekker"), ("4", None), ("5", ""), ("6", "KjÃ¸kken" * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, original string")
    got = {r.id: (r.restored, r.restorable) for r in M.find_garbled(df, "id", "title", model).collect()}
    assert got["2"] == ("Kjøkkensjef", True) and got["3"][1] is False and set(got) == {"2", "3", "6"}
    assert got["6"][0] == "Kjøkken" * 20_000


def test_counts_are_of_all_rows(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("a会",)], "t string")
    got = {r.pair: r.n for r in M.pair_counts([df.repartition(3)]).collect()}
    assert got[ord("a") << 21 | ord("b")] == 2 and sum(got.values()) == 9


def test_rest_of_the_pairs_is_fetched(spark):
    texts = CLEAN * 30 + ["KjÃ¸kkensjef", "Ã…rsmÃ¸tet valgte", "Kj+APg-kkensjef", "M�bel"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, title string").repartition(4)
    whole, small = M.fit([df.select("title")]), M.fit([df.select("title")], most=40)
    assert whole.rest is None and small.rest is not None and len(small.pairs) <= 40
    found = [sorted(map(tuple, M.find_garbled(df, "id", "title", m).select("id", "restored", "restorable").collect())) for m in (whole, small)]
    assert found[0] == found[1] and {t[1] for t in found[0]} >= {"Kjøkkensjef", "Årsmøtet valgte"}


def test_garbled_many_times(model):
    garbled = CLEAN[0]
    for _ in range(5):
        garbled = garbled.encode("utf-8").decode("cp1252")
    assert M.restore(garbled, model)[0] == CLEAN[0]
