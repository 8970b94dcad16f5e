"""Snapshot changes on hand-made deliveries."""

from tindra.operators.snapshots import changes_of_keys, profile_changes

SCHEMA = (
    "delivery_no int, snapshot_id string, organisation_number string, captured_at string, claims map<string,string>, "
    "jobs array<struct<job_id:string,title:string,source_url:string,posted_date:string,retrieved_at:string>>, "
    "activities array<struct<activity_id:string,title:string,retrieved_at:string>>, extra string"
)


def job(key, title, at="t1"):
    return (key, title, "u", None, at)


def test_profile_changes(spark):
    rows = [
        (1, "s", "A", "1", {"x": "1", "y": "1", "retrieved_at": "1"}, [job("j1", "a"), job("j2", "a"), job("j1", "a")], None, "e"),
        (2, "s", "A", "1", {"x": "9"}, [], [], "e"),
        (2, "t", "A", "2", {"x": "2", "y": None, "z": "1", "retrieved_at": "2"}, [job("j2", "b", "t2"), job("j3", "a")], [("n1", "t", "t2"), (None, "t", "t2"), None], "f"),
        (2, "t", "A", "2", {"x": "2", "y": None, "z": "1", "retrieved_at": "2"}, [job("j2", "b", "t2"), job("j3", "a")], [("n1", "t", "t2"), (None, "t", "t2"), None], "f"),
        (1, "s", "B", "1", None, None, None, None),
        (4, "s", "C", "1", {"x": "1"}, [job("j9", "a")], None, None),
        (4, "s", "A", "1", {"x": "2", "z": "1"}, [job("j3", "a", "t3"), job("j2", "b")], [("n1", "t", None)], None),
        (None, "s", "A", "1", None, None, None, None),
        (4, "s", None, "1", None, None, None, None),
    ]
    got = {tuple(r) for r in profile_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        (2, "A", "claim", "x", "CHANGED"), (2, "A", "claim", "y", "REMOVED"), (2, "A", "claim", "z", "ADDED"),
        (2, "A", "job", "j1", "REMOVED"), (2, "A", "job", "j2", "CHANGED"), (2, "A", "job", "j3", "ADDED"), (2, "A", "activity", "n1", "ADDED"),
        (2, "B", "company", "B", "REMOVED"), (4, "C", "company", "C", "ADDED"),
    }


def test_single_delivery_has_no_changes(spark):
    assert profile_changes(spark.createDataFrame([(1, "s", "A", "1", {"x": "1"}, None, None, None)], SCHEMA)).count() == 0


def test_flat_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), (None, 1), ("d", 1), ("d", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), (None, 2), ("e", 1)], "k string, v int")
    assert {tuple(r) for r in changes_of_keys(old, new, ["k"]).collect()} == {("b", "CHANGED"), (None, "CHANGED"), ("d", "REMOVED"), ("e", "ADDED")}
