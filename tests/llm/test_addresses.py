"""Addresses: reading, alignment, and pairs against brute force."""

import itertools
import os
from collections import defaultdict

import pytest

from tests.conftest import DATA
from tindra.llm import addresses as A
from tindra.llm import address_parts as P

PLACES = [("0105", "HUMMELEIDET", "HUMMELEIDET"), ("0112", "HUMMELEIDET", "HUMMELEIDET"), ("0204", "SØLVSJØEN", "SØLVSJØEN")]


def read(address, code=None, town=None, municipality=None):
    return P.parse(address, code, town, municipality, P.Towns(PLACES))


def test_same_house():
    want = read("Nedre Fosseljuvetveien 36", "0204", "SØLVSJØEN")
    for address, code, town in (
        ("36 Nedre Fosseljuvetvegen", "0204", None), ("Ndr. Fosseljuvetvn. 36, 0204 SØLVSJØEN, Norge", None, None), ("c/o Styreleder, Nedre Fosseljuvet vei nr. 36 - 2. etg", "NO-0204", "Sølvsjøen"),
        ("0204 SØLVSJØEN, Bygg 4, Nedre Fosseljuvetveien 36 H0201", None, None), ("Nedre Fosseljuvetv., 36 (SØLVSJØEN)", None, None), ("NEDRE FOSSELJUVETVEIEN 36 SØLVSJOEN", None, None), ("N. Foseljuvetveien 36", None, "SØVLSJØEN"),
    ):
        got = read(address, code, town)
        assert (got.number, got.letter, got.towns) == (want.number, want.letter, want.towns) and A.same_street(A.form_of(got), A.form_of(want)), address


def test_other_houses():
    want = A.form_of(read("Fosseljuvetveien 36", "0204"))
    for address in ("Fosseljuvetgata 36", "Kongleveien 36", "Østre Kongleveien 36"):
        assert not A.same_street(A.form_of(read(address, "0204")), want)
    assert read("Fosseljuvetveien 36 B", "0204").letter == "b" and read("Fosseljuvetveien 36-b", "0204").letter == "b"
    assert read("Postboks 36", "0204").kind == read("P.O. Box 36 Sentrum", "0204").kind == "box"
    assert read("Utlandet") is None and read(None) is None and read("") is None and read("Fosseljuvetveien", "0204") is None
    assert read("x" * 20_000 + " 5", "0204").number == 5


def test_pairs(spark):
    rows = [("b:1", "Kongleveien 5", "0105", None, None), ("b:1", "Kongleveien 5", "0105", None, None), ("p:1", "Kongglev. 5, 2 etg", None, "HUMMELEIDET", None), ("j:1", "Kongleveien 5A, 0105 HUMMELEIDET", None, None, None), ("j:2", "5 Kongleveien 0112 Hummeleidet", None, None, None), ("j:3", "Pb 77", "0105", None, None), ("j:4", "Postboks 77", "0112", None, None), ("j:5", None, None, None, None), (None, "Kongleveien 5", "0105", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id string, address string, code string, town string, municipality string, block string")
    places = spark.createDataFrame(PLACES, "postnummer string, poststed string, kommune string")
    assert sorted(tuple(r) for r in A.same_place_pairs(df, places).collect()) == [("b:1", "j:2"), ("b:1", "p:1"), ("j:2", "p:1"), ("j:3", "j:4")]


def test_pairs_equal_brute_force(spark):
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("the test tables are not here")
    from tindra.llm.queries import _address_records, p5_found

    folder = f"{DATA}/sf0.001"
    by = defaultdict(lambda: defaultdict(list))
    for r in A.parsed_records(_address_records(spark, folder), spark.read.parquet(f"{folder}/postal_places.parquet")).collect():
        by[r.block][r.form].append(r.record_id)
    want = set()
    for forms in by.values():
        parent = {f: f for f in forms}

        def root(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in itertools.combinations(sorted(forms), 2):
            if A.same_street(a, b):
                parent[root(a)] = root(b)
        groups = defaultdict(list)
        for f, ids in forms.items():
            groups[root(f)] += ids
        want |= {p for ids in groups.values() for p in itertools.combinations(sorted(ids), 2)}
    assert {tuple(r) for r in p5_found(spark, folder).collect()} == want and want


def test_align_gaps():
    name = ("name", "kongle"), ("kind", "vei")
    assert A.align(list(name), list(name)) == 0
    assert A.align([("qualifier", "nedre"), *name], list(name)) == A.GAP_OPEN
    assert A.align([("qualifier", "nedre,nordre"), *name], [("qualifier", "nedre"), *name]) == 0
