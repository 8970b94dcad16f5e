"""Pages and companies: parts, beliefs, matches."""

import itertools
import math

import pytest

from pyspark.sql import functions as F

from tindra.llm import entities as E
from tindra.llm.address_parts import Towns
from tindra.llm.entity_parts import company, page

PLACES = [("0105", "HUMMELEIDET", "HUMMELEIDET"), ("0112", "FRØYEIDET", "HUMMELEIDET"), ("0204", "SØLVSJØEN", "SØLVSJØEN")]


def test_parts():
    towns = Towns(PLACES)
    c = company("GLÅFIBRUAIX NORD & CO BAKERI AS", "Hummeleidet", towns)
    assert (c.stem, c.region, c.trade, c.legal) == ("glafibruaix", "nord", "bakeri", "as") and c.municipalities == {"hummeleidet"}
    assert company("BAKERI GLÅFIBRUAIX NORD AS", None, towns, frozenset({"bakeri"})) == company("AS GLÅFIBRUAIX NORD BAKERI", None, towns, frozenset({"bakeri"}))
    assert page("https://x.example", "Kommer snart", None, towns).kind == "parked"
    assert page("https://glafibruaix-holding.example", "Glåfibruaix Holding", None, towns).kind == "related"
    assert page("https://f.example/sok?q=data", "Bedrifter i Frøyeidet – data", "Frøyeidet", towns).kind == "listing"
    assert page("https://x.example", "X", "Frøyedet", towns).places == {"hummeleidet"}
    assert page("https://portal.example/hummeleidet/glafibruaix", None, None, towns).places == {"hummeleidet"}
    assert company(None, None, towns) is None


def test_name_levels(spark):
    places = spark.createDataFrame(PLACES, "postnummer string, poststed string, kommune string")
    c = spark.createDataFrame([("1", "GLÅFIBRUAIX NORD & CO BAKERI AS", "Hummeleidet", "Brød", 2)], "company string, name string, municipality string, industry string, employees int")
    want = (("https://x.example", "Glåfibruaix Bakeri", 4), ("https://x.example", "Glåfibruiax", 3), ("https://glaafibruaixbakeri.example", "Velkommen", 2), ("https://sosial.example/glafibruaix_bakeri", None, 2), ("https://glafbak.example", "Forside", 1), ("https://x.example", "Forside", 0))
    p = spark.createDataFrame([(k, u, t, None, None, None) for k, (u, t, _) in enumerate(want)], "page int, url string, title string, place string, trade string, staff string")
    got = {r.page: r.name for r in E.described_pairs(E.page_parts(p, places), E.company_parts(c, places)).collect()}
    assert got == {k: level for k, (_, _, level) in enumerate(want) if level}


def exact(edges):
    """Marginals by summing over all assignments that keep both kinds of factors."""
    total, on = 0.0, [0.0] * len(edges)
    for bits in itertools.product((0, 1), repeat=len(edges)):
        chosen = [e for e, b in zip(edges, bits, strict=True) if b]
        pages = [e[0] for e in chosen]
        towns = {}
        if len(set(pages)) < len(pages) or any(towns.setdefault(e[1], e[2]) != e[2] for e in chosen if e[2]):
            continue
        weight = math.exp(sum(e[3] for e in chosen))
        total += weight
        for k, b in enumerate(bits):
            on[k] += weight * b
    return [x / total for x in on]


def test_beliefs_are_marginals_on_a_tree(spark):
    edges = [(1, "A", "x", 1.5), (1, "B", "x", 0.5), (2, "A", "y", 0.7), (3, "A", "y", 0.4), (4, "C", None, -1.0)]
    got = {(r.page, r.company): r.confidence for r in E.propagate(spark.createDataFrame(edges, "page int, company string, town string, theta double"), 1e-6, 40).collect()}
    for e, want in zip(edges, exact(edges), strict=True):
        assert abs(got[e[0], e[1]] - want) < 1e-3, (e, got[e[0], e[1]], want)


def test_matches(spark):
    places = spark.createDataFrame(PLACES, "postnummer string, poststed string, kommune string")
    companies = [(str(k), f"{s} {t} AS", m, i, 2) for k, (s, t, m, i) in enumerate(itertools.chain.from_iterable(
        [(s, "BAKERI", "HUMMELEIDET", "Brød"), (s, "RØR", "SØLVSJØEN", "Rørlegger")] for s in ("GLÅFIBRUAIX", "KVIDØSETH", "TREPUKJØLENIM", "SKÅHOHAUGEV", "BRAPUHEIMAL", "NORFOFLÅTON", "ULVSUSLETTA", "HULRØVANGEN")))]
    pages = [(k, f"https://{k}.example", f"{c[1].title()}", "Frøyeidet" if c[2] == "HUMMELEIDET" else "Sølvsjøen", "bakery" if "BAK" in c[1] else "plumbing", None) for k, c in enumerate(companies)]
    pages += [(100, "https://q.example", "Glåfibruaix Bakeri", "Sølvsjøen", "bakery", None), (101, None, None, None, None, None), (0, *pages[0][1:]), (None, "u", "Glåfibruaix", None, None, None)]
    p = spark.createDataFrame([(*x, "c") for x in pages], "page int, url string, title string, place string, trade string, staff string, company_name string")
    c = spark.createDataFrame([*companies, (None, "X AS", None, None, None), ("99", None, None, None, None)], "company string, name string, municipality string, industry string, employees int")
    assert {w for r in E.trades_of_names(c).collect() for w in r.trades} == {"bakeri", "ror"}
    got = {(r.page, r.company) for r in E.match(p, c, places).where("confidence >= 0.5").collect()}
    assert got == {(k, str(k)) for k in range(len(companies))}
    # Names whose words stand in another order.
    turned = c.withColumn("name", F.regexp_replace("name", r"^(\S+) (\S+) (\S+)$", "$2 $1 $3"))
    got = {(r.page, r.company) for r in E.match(p, turned, places).where("confidence >= 0.5").collect()}
    assert got == {(k, str(k)) for k in range(len(companies))}


def test_beliefs_that_do_not_converge_are_told(spark):
    edges = spark.createDataFrame([(1, "A", "x", 1.5), (1, "B", "x", 0.5), (2, "A", "y", 0.7)], "page int, company string, town string, theta double")
    with pytest.warns(UserWarning, match="not converged"):
        E.propagate(edges, 1e-9, 1).collect()


def test_many_pages_of_a_company_do_not_saturate(spark):
    edges = [(k, "A", "x", 3.0) for k in range(400)] + [(1000 + k, "A", "y", 3.0) for k in range(300)]
    got = E.propagate(spark.createDataFrame(edges, "page int, company string, town string, theta double")).groupBy((F.col("page") < 1000).alias("x")).agg(F.min("confidence"), F.max("confidence")).collect()
    ends = {r[0]: r[1:] for r in got}
    assert ends[True][0] > 0.9 and ends[False][1] < 0.01
