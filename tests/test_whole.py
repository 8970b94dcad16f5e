"""Queries over whole tables: rows that a narrower reading leaves out."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from tindra.operators import candidates, identity, ranking, sampling, timestamps


def run(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    return __spark_entry__.queries()[name](spark, str(tmp_path)).collect()


TITLES = ["Årsmøtet » Kontakt oss", "Café Å åpner • ny pris - Les mer", "Łódź | Fjord", "Сотрудничество  и\tavtale", "Ã¥pner ny avdeling", "Fast plass · Oslo", "LANSÉR é", "– « pris »", "  ", "", None, "xé" * 200]


def test_titles_of_all_characters(spark, tmp_path):
    def clean(t):
        one = re.sub(r"[ \t\n\v\f\r]+", " ", t).strip(" ")
        one = re.sub(r"(?i)( - les mer| » kontakt oss)$", "", one)
        return re.sub(r" [|»] [^|»]*$", "", one).strip(" ")[:300].strip() or None

    rows = spark.createDataFrame(list(enumerate(TITLES)), "activity_id int, title string")
    got = run(spark, tmp_path, "clean_titles", activities=rows)
    assert {r.activity_id: r.title for r in got} == {k: clean(t) if t is not None else None for k, t in enumerate(TITLES)}


def test_kinds_of_all_titles(spark, tmp_path):
    rules = [("award", r"pris(en)?\b|award"), ("launch", "åpner|lansér|opens|launch"), ("agreement", "avtale|contract|sammen"), ("event", "fagdag|messen|årsmøte")]
    rows = spark.createDataFrame(list(enumerate(TITLES)), "activity_id int, title string")
    got = run(spark, tmp_path, "activity_kinds", activities=rows)
    want = {k: next((name for name, p in rules if re.search(p, t or "", re.I)), None) for k, t in enumerate(TITLES)}
    assert {r.activity_id: r.kind for r in got} == want and want[6] == "launch" and want[7] == "award"


def test_names_far_down_a_page(spark):
    page = "<html><script>var meny = 1;</script>" + "<li>meny</li>" * 2000
    found = [page + "<p>Fjord Laks Kyst</p>", page + '<script type="application/ld+json">{"name": "Fjord Laks Kyst AS"}</script>', page + "<p>Fjord Laks</p>", "<script>var fjord = 1, laks = 2;</script><style>.kyst {}</style>", page + "<p>post fra Fjord</p>"]
    rows = [("Fjord Laks Kyst AS", "999999990", "post@fjord.no", "Oslo", "https://fjord.no" if k == 4 else "https://a.no", "Hjem", x) for k, x in enumerate(found)]
    df = spark.createDataFrame(rows, "n string, o string, e string, m string, u string, t string, x string")
    got = identity.assess(identity.with_features(df, "n", "o", "e", "m", "u", "t", "x")).select("shared_words", "reason").collect()
    assert [tuple(r) for r in got] == [(3, "most of the name"), (3, "most of the name"), (2, "half of the name"), (0, "too little"), (1, "mail host and name")]


def test_every_pair_of_deliveries(spark, tmp_path):
    jobs = {1: ["j1", "j2"], 2: ["j1"], 3: ["j1", "j3"], 5: []}  # of company a; delivery 4 did not come
    rows = [(d, f"a{d}", "a", f"t{d}", [(j, f"https://a.no/{j}") for j in own], [("https://a.no",)] if d != 5 else [("https://b.no",)]) for d, own in jobs.items()]
    rows += [(1, "b1", "b", "t1", [], []), (3, "b3", "b", "t3", [("j9", None)], []), (2, "old", "a", "t1", [("j2", None)], [])]
    df = spark.createDataFrame(rows, "delivery_no int, snapshot_id string, organisation_number string, captured_at string, jobs array<struct<job_id:string,source_url:string>>, sources array<struct<url:string>>")
    got = run(spark, tmp_path, "gone_jobs", snapshots=df)
    assert sorted((r.delivery_no, r.organisation_number, r.job_id, r.change_type) for r in got) == [(2, "a", "j2", "REMOVED"), (5, "a", "j1", "OBSERVATION_GAP"), (5, "a", "j3", "OBSERVATION_GAP"), (5, "b", "j9", "REMOVED")]
    got = run(spark, tmp_path, "unmatched_companies")
    assert sorted((r.delivery_no, r.organisation_number, r.side) for r in got) == [(2, "b", "previous"), (3, "b", "current"), (5, "b", "previous")]


def test_samples_of_repeated_keys(spark):
    rows = spark.range(100_000).selectExpr("cast(id % 10 as string) as key", "id")
    for seed in range(3):
        hashed = sampling.least_hashed(rows, "key", 50, seed).collect()
        ranked = sampling.bottom_k(rows, "key", 50, f"s{seed}").collect()
        assert len(hashed) == len(ranked) == 50
        assert {r.key for r in ranked} == {sampling.bottom_k(rows.select("key").distinct(), "key", 1, f"s{seed}").first().key}


def test_few_keys_of_many_rows(spark):
    rows = spark.range(200_000).selectExpr("cast(id % 5 as string) as key", "id")
    assert len(sampling.bottom_k(rows, "key", 100, "s").collect()) == len(sampling.least_hashed(rows, "key", 100, 3).collect()) == 100
    assert len(sampling.bottom_k(rows.limit(7), "key", 100, "s").collect()) == 7


def test_long_stamps():
    import pandas as pd

    said = ["Wednesday, 24 September 2025, 12:30:30.123456 +02:00[Europe/Oslo]", "Wednesday, 24 September 2025, 12:30:30.123456 -03:00[America/Argentina/Buenos_Aires]", "2025-09-24T12:30:30." + "1" * 400 + "Z", "24. september" * 200]
    got = timestamps.normal_forms(pd.Series(said)).tolist()
    assert got == ["2025-09-24T10:30:30.123456Z", "2025-09-24T15:30:30.123456Z", "2025-09-24T12:30:30.111111Z", None]


def test_years_beyond_the_tables():
    import pandas as pd

    said = ["2499-07-01T12:00:00", "2500-07-01T12:00:00", "2500-01-01T12:00:00", "9998-07-01T12:00:00", "1850-01-01T12:00:00"]
    assert timestamps.normal_forms(pd.Series(said), "Europe/Oslo").tolist() == ["2499-07-01T10:00:00.000000Z", "2500-07-01T10:00:00.000000Z", "2500-01-01T11:00:00.000000Z", "9998-07-01T10:00:00.000000Z", "1850-01-01T11:17:00.000000Z"]


def test_either_key_equals_a_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), k, rng.choice([None, *"uvwxyz"]), rng.choice([None, *"rstq"])) for k in range(300)]
    seen, want = {}, set()
    for g, k, a, b in rows:
        s = seen.setdefault(g, (set(), set()))
        if a not in s[0] and b not in s[1]:
            want.add((g, k))
            s[0].update({a} - {None})
            s[1].update({b} - {None})
    got = ranking.either_key(spark.createDataFrame(rows, "g string, o int, a string, b string").repartition(5), "g", "a", "b", ["o"])
    assert {(r.g, r.o) for r in got.collect()} == want


def test_walk_equals_a_fold(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), k, rng.random() < 0.3, rng.random() < 0.2) for k in range(60)]
    want, state = {}, {}
    for g, k, skip, hit in rows:
        s = state.setdefault(g, [0, False])
        want[k] = "early_end" if s[1] else "skipped" if skip else "capped" if s[0] >= 3 else "verified" if hit else "rejected"
        s[1] = s[1] or want[k] == "verified"
        s[0] += not skip
    df = spark.createDataFrame(rows, "g string, o int, skip boolean, hit boolean").repartition(4)
    assert {r.o: r.outcome for r in candidates.walk(df, "g", [F.col("o")], F.col("skip"), F.col("hit"), 3).collect()} == want
