import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tindra.session import local_session, ship  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folders(spark, tmp_path_factory):
    """Folders of the test tables, small: ``empty``, and ``odd`` with nulls in every column, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    source = f"{DATA}/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("the test tables are not here")
    made = {kind: tmp_path_factory.mktemp(kind) for kind in ("empty", "odd")}
    clashing = "record_id form word words pos ids n k key keys page company block place town p rate copies tokens line line_no value original restored hash band a b side delivery".split()
    for file in os.listdir(source):
        name = file.removesuffix(".parquet")
        df = spark.read.parquet(f"{source}/{file}")
        df.limit(0).write.parquet(f"{made['empty']}/{file}")
        some = df.limit(40)
        extra = {c: F.lit("clash") for c in clashing if c not in df.columns}
        odd = some.unionByName(some.limit(10))
        if name != "mix_targets" and name != "postal_places":
            for c in df.columns:
                odd = odd.unionByName(some.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
            blank = {f.name: F.lit("" if f.dataType.typeName() == "string" else None).cast(f.dataType) for f in df.schema.fields}
            odd = odd.unionByName(some.limit(1).select(*(v.alias(k) for k, v in blank.items())))
        odd.withColumns(extra).coalesce(2).write.parquet(f"{made['odd']}/{file}")
    return {k: str(v) for k, v in made.items()}
