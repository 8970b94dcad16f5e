"""Names, addresses, days, official answers, candidates, profiles, observations and reports on small frames."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tindra.functions import days, names, urls
from tindra.operators import candidates, extract, identity, observations, official, reports
from tindra.plans import screen
from tindra.sources import bulk


def one(spark, column, *values, schema="v string"):
    """The column over the values, in their order."""
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"k int, {schema}").orderBy("k").select(column).collect()]


def test_names(spark):
    assert one(spark, names.full_words(F.col("v")), "Taksthuset 1 AS", "Berg & Sønn A/S", "A S Vinden", "AS", None) == [["taksthuset", "1"], ["berg", "sonn"], ["vinden"], [], []]
    assert one(spark, names.registered_domain(F.col("v")), "https://www.shop.lys.no/x", "http://a.b.co.uk", "localhost", "https://by.kommune.no", None) == ["lys.no", "b.co.uk", None, "by.kommune.no", None]
    assert one(spark, names.site_root(F.col("v")), "https://g3i.no/", "https://me.wixsite.com/x", "https://ab.no", None) == ["g3i", "", "", ""]
    said = names.spelled_by_site(F.col("v"), F.col("r"))
    assert one(spark, F.struct(said["spelled"], said["rest"]), ("Bærtur Nord AS", "bartur"), ("Fjellbank AS", "fjellbank1"), schema="v string, r string") == [(["bartur"], ["nord"]), ([], ["fjellbank"])]
    assert one(spark, names.is_branch(F.col("v"), F.col("r"), F.col("p")), ("Skogvern i Sandvik", "skogvern", "Sandvik"), ("Skogvern Data", "skogvern", "Oslo"), ("Annet AS", "skogvern", "Oslo"), schema="v string, r string, p string") == [True, False, False]
    assert one(spark, names.account(F.col("v")), "https://x.com/@lys.no", "https://linkedin.com/company/Lys-Bil/about", "https://facebook.com/1234", "https://x.com", None) == ["lysno", "lysbil", "", "", ""]
    assert one(spark, names.account_is_site(F.col("v"), F.col("r")), ("lysno", "lys"), ("villys", "lys"), ("viervindfang", "vindfang"), ("wix", "wix"), schema="v string, r string") == [True, False, True, False]


def test_days(spark):
    assert one(spark, days.day_of(F.col("v")), "15. oktober 2026", "15/10/2026", "2026-10-15T12:00", "2026-02-31", "32.10.2026", "10 foo 2026", "ingen", None) == ["2026-10-15", "2026-10-15", "2026-10-15", "2026-02-31", None, None, None, None]
    assert one(spark, days.day_in_text(F.col("v")), "x 01.02.2020. Publisert: 15.09.2026 av", "Oppdatert 4. mai 2026", "sist 2021-03-04, 1.1.2022", "") == ["2026-09-15", "2026-05-04", "2021-03-04", None]
    assert one(spark, days.deadline_in_text(F.col("v")), "SØKNADSFRIST: 15.10.2026", "Frist: Snarest!", "søk innen 1.2.2020", "Application deadline 3 May 2026", "x") == ["2026-10-15", "snarest", "2020-02-01", "2026-05-03", None]
    assert one(spark, days.day_in_address(F.col("v")), "/a/2026/8/1/b", "/x-2026-08-10-y", "/news/20260512-oil", "/2026/13/1/", "") == ["2026-08-01", "2026-08-10", "2026-05-12", None, None]


def test_addresses_of_pages(spark):
    u = F.col("v")
    assert one(spark, urls.is_article(u), "https://a.no/nyheter/ny-avdeling", "https://a.no/nyheter", "https://a.no/de/news/neue-halle", "https://a.no/nyheter/tag/ny-avdeling", "https://a.no/nyheter/12345678", "https://a.no/om/ny-avdeling", None) == [True, False, False, False, False, False, False]
    assert one(spark, urls.is_posting(u), "https://a.no/karriere/montor", "https://a.no/karriere", "https://a.no/stillinger/12345", "https://a.no/x/montor", None) == [True, False, False, False, False]
    assert one(spark, urls.is_careers_index(u), "https://a.no/no/karriere/", "https://a.no/no", "https://a.no/a/b/jobb", None) == [True, False, False, False]
    assert one(spark, urls.news_section(u), "https://a.no/fag/nyheter-x/en-sak", "https://a.no/b/c") == ["fag/nyheter-x", "b/c"]
    p = one(spark, urls.social_profile(u), "https://www.facebook.com/Lys.Bil/?x=1", "https://no.linkedin.com/company/lys/jobs", "https://linkedin.com/in/meg", "https://twitter.com/lys", "https://x.com/share", "https://youtube.com/@lys/videos", "https://youtu.be/abc", "https://tiktok.com/lys", "https://lys.no", None)
    assert [tuple(x) if x else None for x in p] == [("facebook", "https://facebook.com/Lys.Bil"), ("linkedin", "https://linkedin.com/company/lys"), None, ("x", "https://x.com/lys"), None, ("youtube", "https://youtube.com/@lys"), None, None, None, None]
    b = one(spark, urls.job_board(u), "https://lys.teamtailor.com/jobs#a", "https://www.teamtailor.com/", "https://boards.greenhouse.io/lys", "https://boards.greenhouse.io", "https://linkedin.com/company/lys/jobs/", "https://linkedin.com/company/lys", "https://finn.no", "https://cdn.lever.co/x.js", "https://lys.no", None)
    assert b == ["https://lys.teamtailor.com/jobs", None, "https://boards.greenhouse.io/lys", None, "https://linkedin.com/company/lys/jobs/", None, None, None, None, None]
    assert one(spark, urls.resolved(F.lit("https://a.no/x/y?q=1"), u), "/b", "c", "//d.no/e", "https://f.no", "#g", "mailto:h@i", "") == ["https://a.no/b", "https://a.no/x/c", "https://d.no/e", "https://f.no", None, None, None]


def test_embedded_data_at_any_depth(spark):
    deep = {"@type": "Thing", "x": [{"y": {"@type": ["Thing", "JobPosting"], "title": "A", "sub": {"@type": "JobPosting", "title": "B"}}}]}
    for _ in range(200):
        deep = {"w": deep}
    html = f'<script type="application/ld+json">{json.dumps(deep)}</script><SCRIPT type="application/ld+json">broken</SCRIPT><script type="application/ld+json">[{{"@type": "JobPosting", "name": "C", "hiringOrganization": "D"}}]</script>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>ld+json</p>"), (4, '<script type="application/ld+json">' + "[" * 5000 + "</script>")], "k int, html string")
    assert [(r.k, r.place, r.title, r.employer) for r in extract.postings(df, "k", "html").orderBy("place").collect()] == [(1, 0, "A", None), (1, 1, "B", None), (1, 2, "C", "D")]
    who = spark.createDataFrame([(1, '<script type="application/ld+json">{"@type": "Organization", "name": "L", "sameAs": ["u1", "u2"]}</script>')], "k int, html string")
    assert extract.organisations(who, "k", "html").first().same_as == ["u1", "u2"]


def test_bodies(spark):
    text = b"x" * 500_000
    bodies = [gzip.compress(text), zlib.compress(text), b"plain", gzip.compress(text)[:200], None]
    got = [r[0] for r in spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b binary").orderBy("k").select(extract.decompressed(F.col("b"), 1000)).collect()]
    assert [len(x) if x is not None else None for x in got[:3]] == [1001, 1001, 5] and len(got[3]) > 0 and got[4] is None
    rows = [("æ".encode(), "utf-8"), ("æ".encode("latin-1"), "ISO-8859-1"), ("æ".encode("latin-1"), None), ("æ".encode(), None), (None, "x")]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary, c string").select(extract.decoded(F.col("b"), F.col("c"))).collect()] == ["æ", "æ", "æ", "æ", None]


def test_official_answers(spark):
    account = lambda k, end, kind, money: {"id": k, "regnskapstype": kind, "valuta": "NOK", "regnskapsperiode": {"tilDato": end}, "resultatregnskapResultat": {"driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": money}}}}
    body = json.dumps([account(1, "2022-12-31", "SELSKAP", 100), account(2, "2024-12-31", "KONSERN", 130.5), account(3, "2024-12-31", "SELSKAP", None), account(4, "2023-12-31", "SELSKAP", 110)])
    df = spark.createDataFrame([("a", body), ("b", None), ("c", "{}"), ("d", "nei"), ("e", "[]")], "k string, body string")
    got = [(r.k, r.place, r.record_id, r.year, None if r.revenue is None else float(r.revenue)) for r in official.accounts(df, "k", "body").orderBy("place").collect()]
    assert got == [("a", 1, "3", 2024, None), ("a", 2, "2", 2024, 130.5), ("a", 3, "4", 2023, 110.0)]
    body = json.dumps({"rollegrupper": [{"type": {"kode": "STYR", "beskrivelse": "Styre"}, "sistEndret": "2026-01-02", "roller": [{"type": {"kode": "LEDE"}, "person": {"navn": {"fornavn": "Kari", "mellomnavn": None, "etternavn": "Li"}}}, {"enhet": {"organisasjonsnummer": "1", "navn": "Revisor AS"}, "avregistrert": True}]}, {"type": {"kode": "X"}}]})
    roles = official.roles(spark.createDataFrame([("a", body), ("b", "x"), ("c", None)], "k string, body string"), "k", "body")
    assert sorted((r.name, r.role_code, r.group, r.inactive) for r in roles.collect()) == [("Kari Li", "LEDE", "Styre", False), ("Revisor AS", None, "Styre", True)]
    assert [tuple(r) for r in official.recent_roles(roles, "k", F.lit("2026-06-01").cast("date"), ("STYR",)).collect()] == [("a", "Styre", "2026-01-02", 1)]
    units = official.locations(spark.createDataFrame([("a", '{"_embedded": {"underenheter": [{"navn": "U", "beliggenhetsadresse": {"poststed": "OSLO"}}]}}'), ("b", "{}")], "k string, body string"), "k", "body")
    assert [(r.k, r.place, r.name, r.town) for r in units.collect()] == [("a", 1, "U", "OSLO")]
    assert official.entities(spark.createDataFrame([("a", '{"organisasjonsnummer": "9", "antallAnsatte": "x", "konkurs": "true"}'), ("b", "[1]")], "k string, body string"), "k", "body").select("number", "employees", "bankrupt").collect() == [("9", None, True)]


def test_company_candidates(spark):
    df = spark.createDataFrame([("1", "Lysvind Bil AS", "OSLO", "post@lysvind.no", "www.lysvind-bil.no"), ("2", "Lysvind Bil AS", None, "post@morgruppen.no", ""), ("3", None, None, None, None)], "k string, n string, m string, e string, w string")
    got = {}
    for r in candidates.company_candidates(df, "k", "n", "m", "e", "w").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.tier, r.url))
    assert got["1"][:4] == [("registered site", "https://lysvind-bil.no"), ("mail host", "https://lysvind.no"), ("full name", "https://lysvindbil.no"), ("full name", "https://lysvindbil.com")]
    assert [t for t, _ in got["2"][:3]] == ["full name", "full name", "mail host"] and "3" not in got
    assert all(len({u for _, u in v}) == len(v) <= 18 for v in got.values())


def test_first_provider_and_phrases(spark):
    df = spark.createDataFrame([("a", "p2", 1), ("a", "p1", 2), ("a", "p1", 3), ("b", None, 4), (None, "z", 5), (None, "y", 6)], "k string, p string, v int")
    assert sorted(r.v for r in candidates.first_provider(df, "k", "p", ("p1", "p2")).collect()) == [2, 3, 4, 6]
    said = spark.createDataFrame([("900 1", "LYS  AS", None, "a@lys.no"), ("2", " ", "X", None)], "k string, n string, m string, e string")
    assert [r.phrase for r in candidates.search_phrases(said, "k", "n", "m", "e").orderBy("place").collect()] == ['"LYS AS"', '"LYS AS" 9001', '"LYS" Norge', '"LYS AS" Norge', '"LYS" lys.no']


def test_social_identity(spark):
    rows = [("Lysvind Bil AS", "AS", "https://x.com/lysvindbil", ""), ("Lysvind Bil AS", "AS", "https://x.com/lysvind_asa", ""), ("Bygg AS", "AS", "https://x.com/storbygg", ""), ("Annet AS", "AS", "https://x.com/lysvind_no", "lysvind"), ("Annet AS", "AS", "https://x.com/wix", "lysvind"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, f string, u string, r string")
    got = identity.assess_social(identity.with_social_features(df, "n", "f", "u", F.col("r"), F.lit(None).cast("boolean"))).select("reason").collect()
    assert [r[0] for r in got] == ["whole name", "other legal form", "generic words only", "name of the site", "account of a platform", "no strong sign of the name"]
    pages = spark.createDataFrame([("a", "exact"), ("a", "review"), ("b", "review"), ("c", "exact")], "k string, status string")
    links = spark.createDataFrame([("a", "exact"), ("a", "uncertain"), ("b", "exact")], "k string, status string")
    assert sorted(tuple(r) for r in identity.gated(pages, links, "k").collect()) == [("a", True, 1, 1), ("b", False, 0, 1), ("c", True, 0, 0)]


def test_observations(spark):
    companies = spark.createDataFrame([("1", "https://www.facebook.com/lys"), ("2", "https://lys.no"), (None, "https://x.com/a")], "organisation_number string, website string")
    links = spark.createDataFrame([("1", "x", "https://x.com/b", "t"), ("1", "x", "https://x.com/a", "t"), ("1", None, "u", "t")], "organisation_number string, platform string, url string, retrieved_at string")
    both = observations.unite([observations.registry_social(companies), observations.social_profiles(links), observations.social_profiles(links.withColumn("url", F.lit("later")))])
    assert sorted((r.id, r.source_url, len(r.content_sha256)) for r in both.collect()) == [("registry-social-1-facebook", "https://facebook.com/lys", 64), ("social-1-x", "https://x.com/a", 64)]


def test_reports(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "o int, k string")
    b = spark.createDataFrame([(1, "x"), (2, "w")], "o int, k string")
    assert sorted(tuple(r) for r in reports.order_mismatches([("a", a), ("b", b)], "o", "k").collect()) == [(2, "y", "w"), (3, "z", None)]
    scores = {r.case: tuple(r)[1:] for r in reports.suite_scores([("same", a, a), ("less", a.limit(2), a), ("none", a.limit(0), a.limit(0))], "k").collect()}
    assert scores == {"same": (3, 3, 3, True), "less": (3, 2, 2, False), "none": (0, 0, 0, True)}
    empty = reports.envelopes(spark.createDataFrame([("1",), ("1",), ("2",)], "organisation_number string"), spark.createDataFrame([("1", "registry", "available")], "organisation_number string, module string, state string"), {})
    assert sorted(tuple(r) for r in empty.collect()) == [("1", "available", "registry=available"), ("2", "failed", "")]
    assert one(spark, reports.terminal_state(F.col("v"), F.lit("website"), F.col("p")), ("available", False), ("available", None), (None, True), ("blocked", False), schema="v string, p boolean") == ["ambiguous", "available", "failed", "blocked"]
    s = spark.createDataFrame([("1", "Lys AS", 2), ("2", None, None)], "organisation_number string, name string, employees int")
    t = spark.createDataFrame([("1", 2024, 1234567, 12.5)], "organisation_number string, year int, revenue bigint, change_pct double")
    assert {r.summary for r in reports.summaries(s, t).collect()} == {"Lys AS: revenue of NOK 1,234,567 in 2024 (up 12.5 %) and 2 registered employees.", "The company: nothing known."}
    assert reports.found_in(s, "", "name").count() == 2


def test_screens_name_what_they_rest_on():
    plan = screen.parse("companies with a website and revenue over 5 million top 3 by employees")
    assert screen.involved(plan) == ["financials", "registry", "website"]
    assert screen.parse("companies with many reviews and no website").unsupported == (screen.REASONS["opinions"], screen.REASONS["absence"])


def test_request_lists(spark, tmp_path):
    said = {"a.json": '["999 999 990", 888888888]', "b.json": '{"organisation_numbers": ["999999990", "888888888"]}', "c.jsonl": '{"organisation_number": "999999990", "evaluation_split": "test"}\r\n\r\n{"organisation_number": 888888888}\n', "d.txt": "﻿999999990\n888 888 888\n"}
    for name, content in said.items():
        (tmp_path / name).write_text(content, "utf-8")
        got = bulk.read_requests(spark, str(tmp_path / name)).orderBy("ordinal").collect()
        assert [r.organisation_number for r in got] == ["999999990", "888888888"], name
        assert name != "c.jsonl" or [r.evaluation_split for r in got] == ["test", None]
    (tmp_path / "e.txt").write_text("12\n")
    with pytest.raises(ValueError):
        bulk.read_requests(spark, str(tmp_path / "e.txt"))


def test_titles_and_kinds(spark):
    from tindra.functions import text

    said = ("Publisert: 01.02.2024 kl. 10:00 | Ny hall på Åsen", "Nyheter: Vi åpner", "Kontakt oss", "Vi vant 13.04.2021 - Publisert av Kari", "– Sterkt år –", "x", None, "")
    assert one(spark, text.headline(F.col("v")), *said) == ["Ny hall på Åsen", "Vi åpner", None, "Vi vant", "Sterkt år", None, None, None]
    assert one(spark, text.posting_title(F.col("v")), "• Montør  søkes •", "Ledige stillinger", "ab", None, "x" * 300) == ["Montør søkes", None, None, None, "x" * 200]
    assert one(spark, text.activity_kind(F.col("v"), F.col("b")), ("Pressemelding: ny avtale", None), ("Ny avtale", "lanserer"), ("Pris for service", None), ("Priset", None), (None, None), schema="v string, b string") == ["press_release", "partnership", "award", "company_update", "company_update"]


def test_additions_and_keys(spark):
    from tindra.operators import aggregates, history, synthesis

    before = spark.createDataFrame([("a", "u1"), ("b", "u1")], "k string, u string")
    after = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("a", "u2"), ("c", "u3")], "k string, u string")
    assert [tuple(r) for r in history.added(before, after, before.select("k"), ["k"], ["u"]).collect()] == [("a", "u2")]
    claims = spark.createDataFrame([("a", 1, {"x": "1", "y": None, "retrieved_at": "t1"}), ("a", 2, {"retrieved_at": "t2", "x": "1"}), ("a", 3, {"x": "2"}), ("b", 1, None)], "k string, d int, c map<string,string>")
    got = {(r.k, r.d): r.profile_hash for r in history.keyed(claims, "k", "d", "c").collect()}
    assert got["a", 1] == got["a", 2] != got["a", 3] and len(got["b", 1]) == 64
    trends = spark.createDataFrame([("a", 12.0), ("b", -10.0), ("c", 3.0), ("d", None)], "organisation_number string, change_pct double")
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "organisation_number string, n int")
    said = sorted((r[0], r.statement) for r in synthesis.inferences(trends, counts, counts).collect())
    assert said == [("a", "growing"), ("a", "recruiting"), ("b", "contracting"), ("b", "publishing"), ("b", "recruiting")]
    assert sorted(tuple(r) for r in aggregates.coverage({"x": counts, "y": counts.limit(0)}, "organisation_number").collect()) == [("x", 2, 2), ("y", 0, 0)]


def test_clashing_column_of_turns(spark):
    from tindra.operators import ranking

    df = spark.createDataFrame([("a", "s", 1, 1), ("a", "t", 2, 2)], "k string, section string, place int, day int")
    got = ranking.round_robin(df.drop("place"), "k", "section", [F.desc("day")], "day", 5)
    assert [(r.section, r.place) for r in got.orderBy("place").collect()] == [("t", 1), ("s", 2)]
