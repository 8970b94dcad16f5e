"""All registered queries: against SQL on the small tables, and on empty and odd tables."""

import os

import pytest

import __spark_entry__
from tests.conftest import DATA

LLM = {name for name in __spark_entry__.queries() if name.startswith("p") and name[1:2].isdigit() and name[1] not in "34"}
OWN = [name for name in __spark_entry__.queries() if name not in LLM]


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_entry(spark):
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("the test tables are not here")
    assert __spark_entry__.entry(spark).columns == ["delivery_no", "organisation_number", "entity_type", "entity_key", "change_type"]


@pytest.mark.parametrize("name", [n for n in OWN if n in __spark_entry__.oracle_sql()])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    got = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(got.columns)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", OWN)
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_empty_and_odd_tables(spark, folders, name, kind):
    __spark_entry__.queries()[name](spark, folders[kind]).collect()
