"""Core operators on small frames: ties, nulls, order."""

import pytest
from pyspark.sql import functions as F

from tindra.functions import text, urls
from tindra.operators import aggregates, candidates, evidence, extract, history, identity, lookup, ranking, sampling, synthesis
from tindra.plans import screen, workspace
from tindra.sources import bulk


def test_addresses(spark):
    df = spark.createDataFrame([("https://www.Example.no/",), ("http://example.no",), ("https://example.no/about/?q=1#x",), ("example.no:8080/a",), (None,), ("",)], "u string")
    got = [tuple(r) for r in df.select(urls.canonical(F.col("u")), urls.host(F.col("u"))).collect()]
    assert got == [("https://example.no", "example.no"), ("https://example.no", "example.no"), ("https://example.no/about", "example.no"), ("https://example.no/a", "example.no"), (None, None), (None, None)]
    scope = spark.createDataFrame([("https://a.no/x", "https://www.a.no/x/y", True), ("https://a.no/x", "https://a.no/xy", False), ("https://a.no", "https://b.a.no/z", True), ("https://a.no", "https://ba.no", False)], "s string, u string, w boolean")
    assert all(r[0] == r[1] for r in scope.select(urls.in_scope(F.col("s"), F.col("u")), "w").collect())


def test_words(spark):
    df = spark.createDataFrame([("LUFT KÅRE A/S",), ("Æske & Sønn AS",), (None,)], "n string")
    assert [r[0] for r in df.select(text.tokens(F.col("n"))).collect()] == [["luft", "kare"], ["aeske", "sonn"], []]


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    a = sampling.bottom_k(df, "key", 20, "s").collect()
    assert a == sampling.bottom_k(df.repartition(7).orderBy(F.desc("key")), "key", 20, "s").collect()
    stepped = sampling.every_step(spark.range(101), [F.col("id")], 10).orderBy("position").collect()
    assert [r.id for r in stepped] == [r.position for r in stepped] == list(range(0, 100, 10))
    assert sampling.every_step(spark.range(0), [F.col("id")], 10).count() == 0


def test_lookup(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "ordinal int, key string")
    store = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "key string, v string, version int")
    assert [tuple(r) for r in lookup.lookup(asked, store, "key", "ordinal", "version").collect()] == [(1, "a", True, "new", 2), (2, "x", False, None, None), (3, None, False, None, None)]
    assert {r.ordinal for r in lookup.missing(asked, store, "key").collect()} == {2, 3}
    both = lookup.fill_gaps(spark.createDataFrame([("a", ""), ("b", "w")], "key string, v string"), store, "key", ["v"])
    assert {r.key: r.v in ("old", "new", "w") for r in both.collect()} == {"a": True, "b": True}


def test_either_key(spark):
    rows = [("c", 1, "u1", "t1"), ("c", 2, "u1", "t2"), ("c", 3, "u2", "t2"), ("c", 4, "u3", "t1"), ("c", 5, None, None), ("c", 6, None, None), ("d", 1, "u1", "t1")]
    df = spark.createDataFrame(rows, "g string, o int, a string, b string")
    assert sorted((r.g, r.o) for r in ranking.either_key(df, "g", "a", "b", ["o"]).collect()) == [("c", 1), ("c", 3), ("c", 5), ("c", 6), ("d", 1)]


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("a", None), ("b", 5.0), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95) for r in aggregates.order_statistics(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (4, 3.0, 4.0), "b": (1, 5.0, 5.0)}


def test_states(spark):
    df = spark.createDataFrame([(s,) for s in ("available", "not_found", "source_error", "blocked_robots", "something_new", "AVAILABLE", None)], "s string")
    assert [r[0] for r in df.select(evidence.state(F.col("s"))).collect()] == ["available", "not_available", "failed", "blocked", "failed", "failed", "failed"]


def test_carry_forward_and_changes(spark):
    now = spark.createDataFrame([("a", "m", "failed", 1), ("a", "n", "failed", 1), ("b", "m", "available", 5)], "org string, module string, state string, v int")
    old = spark.createDataFrame([("a", "m", "available", 9), ("a", "n", "failed", 8), ("b", "m", "available", 7)], "org string, module string, state string, v int")
    got = {(r.org, r.module): (r.state, r.v, r.carried_forward) for r in evidence.carry_forward(now, old, ["org", "module"]).collect()}
    assert got == {("a", "m"): ("available", 9, True), ("a", "n"): ("failed", 1, False), ("b", "m"): ("available", 5, False)}
    a = spark.createDataFrame([("x", "1", None), ("y", None, None)], "k string, p string, q string")
    b = spark.createDataFrame([("x", "2", None), ("y", None, "n"), ("z", "1", "1")], "k string, p string, q string")
    assert {tuple(r) for r in history.field_changes(a, b, "k", ["p", "q"]).collect()} == {("x", "p", "1", "2"), ("y", "q", None, "n")}
    assert [tuple(r) for r in history.unmatched_keys(a, b, "k").collect()] == [("z", "current")]


def test_trend(spark):
    df = spark.createDataFrame([("a", 2022, 100), ("a", 2024, 120), ("a", 2023, 100), ("b", 2024, 5), ("c", 2024, 5), ("c", 2023, 0)], "k string, y int, v int")
    assert {r.k: r.change_pct for r in history.trend(df, "k", "y", "v").collect()} == {"a": 20.0, "b": None, "c": None}


def test_walk(spark):
    rows = [("h", 1, True, False), ("h", 2, False, False), ("h", 3, False, True), ("h", 4, False, True), ("g", 1, False, False), ("g", 2, False, False), ("g", 3, None, True)]
    df = spark.createDataFrame(rows, "k string, o int, skip boolean, hit boolean")
    got = {(r.k, r.o): r.outcome for r in candidates.walk(df, "k", [F.col("o")], F.col("skip"), F.col("hit"), 2).collect()}
    assert got == {("h", 1): "skipped", ("h", 2): "rejected", ("h", 3): "verified", ("h", 4): "early_end", ("g", 1): "rejected", ("g", 2): "rejected", ("g", 3): "capped"}


def test_domain_candidates(spark):
    df = spark.createDataFrame([("1", "ØVRE SKYGGE PRODUKTER AS", "OSLO", "post@osp.no"), ("2", "Bakketun Borettslag", None, "x@gmail.com"), ("3", None, None, None)], "k string, n string, m string, e string")
    got = candidates.domain_candidates(df, "k", "n", "m", "e").collect()
    one = [r.url for r in got if r.k == "1"]
    assert one[0] == "https://osp.no" and "https://ovreskygge.no" in one and len(one) == len(set(one)) <= 14
    assert "https://bakketun.no" in [r.url for r in got if r.k == "2"] and not [r for r in got if r.k == "3"]


def test_identity_order(spark):
    row = ("Fjord Data AS", "999999990", "post@fjorddata.no", "Oslo", "https://fjorddata.no", "Fjord Data", "Fjord Data i Oslo. Org.nr. 999 999 990 " + "x" * 100)
    other = (*row[:5], "404 not found", row[6])
    rival = (*row[:6], "Org.nr. 888888888")
    df = spark.createDataFrame([row, other, rival, (None,) * 7], "n string, o string, e string, m string, u string, t string, x string")
    got = identity.assess(identity.with_features(df, "n", "o", "e", "m", "u", "t", "x")).select("reason", "status").collect()
    assert [tuple(r) for r in got] == [("own number", "exact"), ("error page", "uncertain"), ("number of another company", "uncertain"), ("too little", "uncertain")]


def test_extraction(spark):
    xml = "<urlset><url><loc>https://a.no/1</loc><lastmod>2026-01-01</lastmod></url><url><loc><![CDATA[https://a.no/2?a=1&b=2]]></loc></url><url/></urlset>"
    feed = "<rss><channel><title>f</title><item><title>A &amp; B</title><link>https://a.no/x</link><pubDate>Mon, 01 Sep 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    html = '<html><head><title>T</title><script>var a = "<h1>no</h1>";</script><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "x"}, {"@type": ["Thing", "JobPosting"]}]}</script></head><body><h1>H</h1><a href="/a">1</a><a href="/a">2</a></body></html>'
    df = spark.createDataFrame([(1, xml, feed, html), (2, None, None, None), (3, "", "", "")], "k int, x string, f string, h string")
    assert [tuple(r) for r in extract.sitemap(df, "k", "x").collect()] == [(1, 0, "https://a.no/1", "2026-01-01"), (1, 1, "https://a.no/2?a=1&b=2", None)]
    assert [tuple(r)[2:] for r in extract.feed(df, "k", "f").collect()] == [("A & B", "https://a.no/x", "Mon, 01 Sep 2026 10:00:00 GMT")]
    assert extract.json_ld(df, "k", "h", "JobPosting").count() == 2
    assert [tuple(r) for r in extract.html_facts(df, "k", "h").where("k = 1").collect()] == [(1, "T", "H", 1)]
    assert [tuple(r) for r in extract.links(df, "k", "h").collect()] == [(1, 0, "/a", "1"), (1, 1, "/a", "2")]


@pytest.mark.parametrize(
    ("words", "filters", "sort"),
    [
        ("companies in Oslo with revenue over 10 million", [("municipality", "eq", "OSLO"), ("revenue", ">", 10_000_000)], None),
        ("companies in Oslo top 5 by revenue", [("municipality", "eq", "OSLO")], ("revenue", 5)),
        ("at least 50 employees and legal form is ASA", [("legal_form", "eq", "ASA"), ("employees", ">=", 50)], None),
        ("more than 1,000,000 revenue", [("revenue", ">", 1_000_000)], None),
        ("employees <= 3 and unprofitable", [("employees", "<=", 3), ("annual_result", "<", 0)], None),
        ("profitable companies that have annual accounts", [("annual_result", ">", 0), ("financials", "available", True)], None),
        ("companies with an official website where industry contains 'Fisk'", [("website", "present", True), ("industry", "contains", "fisk")], None),
        ("revenue at most NOK 2.5bn top 500 by employees", [("revenue", "<=", 2_500_000_000)], ("employees", 100)),
    ],
)
def test_screens(words, filters, sort):
    plan = screen.parse(words)
    assert [(f.field, f.operator, f.value) for f in plan.filters] == filters and plan.sort == sort and plan.executable


@pytest.mark.parametrize("words", ["companies in Oslo with good sentiment", "companies without a website", "tell me a story", ""])
def test_screens_that_abstain(words):
    assert not screen.parse(words).executable


def test_bulk(spark, tmp_path):
    import gzip

    csv = "﻿organisasjonsnummer;navn;antallAnsatte;konkurs;forretningsadresse.kommune\n999999990;Fjord AS;12;true;OSLO\n12;Kort;1;false;X\n888888888;;x;;\n"
    (tmp_path / "a.csv").write_text(csv, "utf-8")
    with gzip.open(tmp_path / "b.csv.gz", "wt", encoding="utf-8") as f:
        f.write(csv)
    (tmp_path / "c.jsonl").write_text('{"organisation_number": "999999990", "name": "Fjord AS", "employees": 12, "bankrupt": true}\n\n{broken\n')
    for name in ("a.csv", "b.csv.gz", "c.jsonl"):
        rows = {r.organisation_number: r for r in bulk.read_bulk(spark, str(tmp_path / name)).collect()}
        assert (rows["999999990"].name, rows["999999990"].employees, rows["999999990"].bankrupt) == ("Fjord AS", 12, True)
        assert "12" not in rows
    (tmp_path / "pointer.csv").write_text("version https://git-lfs.github.com/spec/v1\n")
    with pytest.raises(ValueError):
        bulk.read_bulk(spark, str(tmp_path / "pointer.csv"))
    (tmp_path / "ask.txt").write_text("999 999 990\n\n888888888\n")
    assert [r.organisation_number for r in bulk.read_requests(spark, str(tmp_path / "ask.txt")).orderBy("ordinal").collect()] == ["999999990", "888888888"]
    (tmp_path / "ask.txt").write_text("999999990\n999999990\n")
    with pytest.raises(ValueError):
        bulk.read_requests(spark, str(tmp_path / "ask.txt"))
    bulk.write_csv(spark.createDataFrame([("a", [1])], "k string, v array<int>"), str(tmp_path / "out"))
    assert "[1]" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert bulk.read_log(spark, str(tmp_path / "none.jsonl"), "a string").count() == 0


def test_content_store_and_references(spark):
    pages = spark.createDataFrame([("https://www.a.no/x/", "r1"), ("http://a.no/x", "r0"), (None, "r2")], "url string, ref string")
    items = spark.createDataFrame([("1", "https://a.no/x?y=1", None), ("2", None, "https://a.no/x"), ("3", "https://b.no", None)], "id string, s string, f string")
    got = {r.id: r.ref for r in evidence.attach_references(items, pages, ["s", "f"], "url", "ref").collect()}
    assert got == {"1": "r0", "2": "r0", "3": None}
    bodies = spark.createDataFrame([("x", "page"), ("x", "page"), ("y", "page"), (None, "page")], "body string, kind string")
    once = evidence.store_bodies(bodies.limit(2), "body", "kind")
    assert sorted((r.body, r.is_new) for r in evidence.store_bodies(bodies, "body", "kind", once).collect()) == [("x", False), ("y", True)]


def test_phrases_and_rules(spark):
    df = spark.createDataFrame([("a b c", "b c"), ("a b c", "c d"), ("a", "a b"), ("a", ""), ("", "")], "t string, p string")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    assert [r[0] for r in df.select(text.has_phrase(split(F.col("t")), split(F.col("p")))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(text.first_rule([("x", "B C"), ("y", "a")], F.col("t"))).collect()] == ["x", "x", "y", "y", None]


def test_best_of(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 9, None)], "k string, o int, s int")
    assert {(r.k, r.o) for r in ranking.best_of(df, ["k"], F.col("s"), [F.col("o")]).collect()} == {("a", 1), ("b", 9)}


def test_publication_day_and_search(spark):
    rows = [('<meta property="article:published_time" content="2026-01-02T00:00">', "u"), ('{"datePublished": "2026-01-03"}', "u"), ('<time datetime="2026-01-04">', "u"), ("", "https://a.no/2026/01/05/x"), ("on 2026-01-06 and 2026-01-06", "u"), ("2026-01-06 2026-01-07", "u"), (None, None)]
    df = spark.createDataFrame(rows, "h string, u string")
    assert [r[0] for r in df.select(extract.publication_day(F.col("h"), F.col("u"))).collect()] == ["2026-01-02", "2026-01-03", "2026-01-04", "2026-01-05", "2026-01-06", None, None]
    found = spark.createDataFrame([(1, '{"web": {"results": [{"url": "u1", "title": "t"}, {"title": "x"}, {"url": "u2"}]}}'), (2, "broken"), (3, None)], "k int, b string")
    assert [(r.rank, r.url) for r in extract.search_results(found, "k", "b").collect()] == [(1, "u1"), (3, "u2")]


def test_questions():
    assert synthesis.topics_of("What is the revenue?") == ["financials"] and synthesis.topics_of("employee sentiment") is None and len(synthesis.topics_of("hello")) == len(synthesis.TOPICS)


def test_workspace(tmp_path):
    path = str(tmp_path / "w.json")
    (tmp_path / "w.json").write_text("{broken")
    w = workspace.load(path)
    for k in range(105):
        w = workspace.record(w, f"q{k}", ["b", "a"], pin=k == 0)
    workspace.save(path, w)
    assert workspace.load(path)["pins"] == ["a", "b"] and len(workspace.load(path)["history"]) == 100
