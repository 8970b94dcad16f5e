from tindra.streaming.snapshots import arrivals, once_each, state_changes

SCHEMA = "org string, state string, at timestamp"


def run(stream, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_state_changes(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", "available", "2026-01-01 00:00:00"), ("a", "available", "2026-01-02 00:00:00"), ("a", "failed", "2026-01-03 00:00:00"), (None, "failed", "2026-01-01 00:00:00")]
    spark.createDataFrame(rows, "org string, state string, at string").selectExpr("org", "state", "cast(at as timestamp) at").coalesce(1).write.parquet(folder)
    got = run(state_changes(arrivals(spark, folder, SCHEMA), "org", "state", "at"), spark, "changes")
    assert [(r.key, r.before, r.after) for r in got] == [("a", None, "available"), ("a", "available", "failed")]


def test_once_each(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "x")] * 3 + [("b", "x")], "org string, state string").selectExpr("org", "state", "timestamp '2026-01-01' at").coalesce(1).write.parquet(folder)
    assert sorted(r.org for r in run(once_each(arrivals(spark, folder, SCHEMA), ["org"], "at"), spark, "once")) == ["a", "b"]
