"""Each query over empty tables, and over tables with nulls, repeated rows and clashing columns."""

import pytest

pytest.importorskip("tindra.llm")

from tindra.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    got = QUERIES[name](spark, folders["empty"]).collect()
    assert not got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd(spark, folders, name):
    QUERIES[name](spark, folders["odd"]).collect()
