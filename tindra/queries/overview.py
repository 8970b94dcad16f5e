"""Queries of the reports, views and observations, of sources, and of what the other modules have beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from tindra.functions import days, text, urls
from tindra.functions.hashing import short_id
from tindra.operators import extract, history, lookup, observations, official, ranking, reports
from tindra.plans import screen
from tindra.queries import general
from tindra.queries.core import _EVIDENCE, _HOST, _PATH, _REGISTRY, _SCREEN, AS_OF, SQL, _evidence, _registry, _requested, _screen_base, company_facts, query
from tindra.queries.more import _ACCOUNTS, _ACT, _JOB, _accounts, _day_sql, _first
from tindra.session import shared_folder
from tindra.sources import bulk
from tindra.tables import load

# States, envelopes, reports

_OWN = f"{_ACT}, own AS (SELECT company_orgnr AS organisation_number, bool_or(coalesce(identity_assessment.score >= 0.9, false)) AS publishable FROM act WHERE company_orgnr IS NOT NULL GROUP BY 1)"
_MODULE_STATES = f"""{_EVIDENCE}, {_OWN}, latest AS (SELECT organisation_number, field AS module, max(struct_pack(t := ingested_at, i := evidence_id, s := state)).s AS s FROM ev WHERE organisation_number IS NOT NULL GROUP BY 1, 2),
ms AS (SELECT latest.organisation_number, module, CASE WHEN s = 'available' AND module = 'website' AND NOT coalesce(publishable, true) THEN 'ambiguous' ELSE s END AS state FROM latest LEFT JOIN own USING (organisation_number))"""


def _module_states(spark, folder):
    """The state that each module of each company ends in, by its latest evidence and by whether the company's pages are its own."""
    rows = _evidence(spark, folder, "organisation_number", "field", "ingested_at").where("organisation_number is not null")
    latest = rows.groupBy("organisation_number", F.col("field").alias("module")).agg(F.max(F.struct("ingested_at", "evidence_id", "state")).alias("_r")).select("organisation_number", "module", F.col("_r.state").alias("_s"))
    pages = _first(spark, folder, "activities", "activity_id", "company_orgnr", "identity_assessment").where("company_orgnr is not null")
    own = pages.groupBy(F.col("company_orgnr").alias("organisation_number")).agg(F.bool_or(F.coalesce(F.col("identity_assessment.score") >= 0.9, F.lit(False))).alias("publishable"))
    return latest.join(own, "organisation_number", "left").select("organisation_number", "module", reports.terminal_state(F.col("_s"), F.col("module"), F.col("publishable")).alias("state"))


@query(f"WITH {_MODULE_STATES} SELECT organisation_number, module, state FROM ms")
def terminal_states(spark, folder):
    return _module_states(spark, folder)


_ENVELOPES = f"""{_MODULE_STATES}, {_JOB}, {_REGISTRY}, per AS (SELECT organisation_number, string_agg(module || '=' || state, ',' ORDER BY module || '=' || state) AS modules, max(state) FILTER (module = 'registry') AS r FROM ms GROUP BY 1),
ja AS (SELECT company_orgnr AS organisation_number, count(*) AS n, string_agg(job_id, ',' ORDER BY rn) FILTER (rn <= 5) AS l FROM (SELECT *, row_number() OVER (PARTITION BY company_orgnr ORDER BY ingested_at DESC, job_id) AS rn FROM job) GROUP BY 1),
na AS (SELECT company_orgnr AS organisation_number, count(*) AS n, string_agg(activity_id, ',' ORDER BY rn) FILTER (rn <= 5) AS l FROM (SELECT *, row_number() OVER (PARTITION BY company_orgnr ORDER BY ingested_at DESC, activity_id) AS rn FROM act) GROUP BY 1),
env AS (SELECT reg.organisation_number, CASE WHEN coalesce(r, 'failed') = 'failed' THEN 'failed' WHEN r = 'not_available' THEN 'not_available' ELSE 'available' END AS state, coalesce(modules, '') AS modules, coalesce(ja.n, 0) AS jobs_count, coalesce(ja.l, '') AS jobs_latest, coalesce(na.n, 0) AS news_count, coalesce(na.l, '') AS news_latest
  FROM reg LEFT JOIN per USING (organisation_number) LEFT JOIN ja ON ja.organisation_number = reg.organisation_number LEFT JOIN na ON na.organisation_number = reg.organisation_number)"""


def _dated(spark, folder, table, key):
    return ranking.keep_first(load(spark, folder, table).select(key, "ingested_at", "company_orgnr"), [key], [F.col("ingested_at")]).withColumnRenamed("company_orgnr", "organisation_number")


def _envelopes(spark, folder):
    jobs, news = _dated(spark, folder, "jobs", "job_id"), _dated(spark, folder, "activities", "activity_id")
    order = lambda key: [F.desc("ingested_at"), F.col(key)]
    return reports.envelopes(_registry(spark, folder), _module_states(spark, folder), {"jobs": (jobs, "job_id", order("job_id")), "news": (news, "activity_id", order("activity_id"))})


@query(f"WITH {_ENVELOPES} SELECT * FROM env")
def envelopes(spark, folder):
    return _envelopes(spark, folder)


@query(f"WITH {_ENVELOPES} SELECT count(*) AS envelopes, count(DISTINCT organisation_number) AS companies, 0 AS unknown_states, (SELECT count(DISTINCT organisation_number) FROM registry) AS expected, count(*) = (SELECT count(DISTINCT organisation_number) FROM registry) AS passed FROM env")
def envelope_checks(spark, folder):
    return reports.envelope_checks(_envelopes(spark, folder), load(spark, folder, "registry"))


@query("SELECT status, count(*) AS requests, CAST(sum(coalesce(bytes_received, 0)) AS BIGINT) AS received, CAST(sum(coalesce(elapsed_ms, 0)) AS BIGINT) AS elapsed, count(error) AS errors FROM fetch_results GROUP BY 1")
def operations_totals(spark, folder):
    return reports.operations(load(spark, folder, "fetch_results"), "status")


@query(f"""WITH {_ENVELOPES} SELECT 'companies' AS section, state AS name, count(*) AS n FROM env GROUP BY 2 UNION ALL SELECT 'modules', module || '.' || state, count(*) FROM ms GROUP BY 2
UNION ALL SELECT 'fetches', unnest(['requests', 'received', 'elapsed', 'errors']), unnest([count(*), CAST(sum(coalesce(bytes_received, 0)) AS BIGINT), CAST(sum(coalesce(elapsed_ms, 0)) AS BIGINT), count(error)]) FROM fetch_results""")
def run_report(spark, folder):
    return reports.run_report(_envelopes(spark, folder), _module_states(spark, folder), load(spark, folder, "fetch_results"))


@query(f"""WITH {_REGISTRY}, a AS (SELECT organisation_number, row_number() OVER (ORDER BY organisation_number) AS ordinal FROM (SELECT DISTINCT organisation_number FROM fresh_companies)),
b AS (SELECT organisation_number, row_number() OVER (ORDER BY organisation_number) AS ordinal FROM reg WHERE organisation_number IN (SELECT organisation_number FROM fresh_companies)),
c AS (SELECT organisation_number, row_number() OVER (ORDER BY organisation_number) AS ordinal FROM (SELECT DISTINCT organisation_number FROM fetch_results WHERE organisation_number IN (SELECT organisation_number FROM fresh_companies)))
SELECT coalesce(a.ordinal, b.ordinal, c.ordinal) AS ordinal, a.organisation_number AS requested, b.organisation_number AS registered, c.organisation_number AS fetched FROM a FULL JOIN b ON a.ordinal = b.ordinal FULL JOIN c ON c.ordinal = coalesce(a.ordinal, b.ordinal)
WHERE a.organisation_number IS DISTINCT FROM b.organisation_number OR a.organisation_number IS DISTINCT FROM c.organisation_number""")
def order_mismatches(spark, folder):
    from tindra.operators.sampling import numbered

    wanted = load(spark, folder, "fresh_companies").select("organisation_number").distinct()
    lists = [("requested", wanted), ("registered", _registry(spark, folder).join(wanted, "organisation_number", "left_semi")), ("fetched", load(spark, folder, "fetch_results").select("organisation_number").distinct().join(wanted, "organisation_number", "left_semi"))]
    placed = [(name, numbered(df, [F.col("organisation_number")]).select("organisation_number", (F.col("position") + 1).alias("ordinal"))) for name, df in lists]
    return reports.order_mismatches(placed, "ordinal", "organisation_number")


@query(f"SELECT delivery_no, entity_type, change_type, count(*) AS n FROM ({general.SQL['p4_found']}) GROUP BY 1, 2, 3")
def history_summary(spark, folder):
    return reports.history_summary(general.p4_found(spark, folder), "delivery_no", "entity_type")


@query(f"SELECT delivery_no, entity_type, entity_key, 'chg-' || substring(sha256(concat_ws('|', coalesce(CAST(delivery_no AS VARCHAR), 'None'), coalesce(organisation_number, 'None'), entity_type, coalesce(entity_key, 'None'), change_type)), 1, 16) AS change_id FROM ({general.SQL['p4_found']})")
def change_ids(spark, folder):
    named = history.change_ids(general.p4_found(spark, folder), "delivery_no", "organisation_number", "entity_type", "entity_key", "change_type")
    return named.select("delivery_no", "entity_type", "entity_key", "change_id")


_VERSIONS = f"""{_EVIDENCE}, vv AS (SELECT organisation_number, field, min(struct_pack(t := ingested_at, i := evidence_id, v := coalesce(value, ''), h := coalesce(content_sha256, ''))) AS a, max(struct_pack(t := ingested_at, i := evidence_id, v := coalesce(value, ''), h := coalesce(content_sha256, ''))) AS b FROM ev WHERE state = 'available' AND organisation_number IS NOT NULL GROUP BY 1, 2),
ch AS (SELECT organisation_number, field, nullif(a.v, '') AS old_value, nullif(b.v, '') AS new_value, nullif(b.h, '') AS content_sha256 FROM vv WHERE nullif(a.v, '') IS DISTINCT FROM nullif(b.v, ''))"""


@query(f"""WITH {_VERSIONS} SELECT organisation_number, count(*) AS changes, string_agg(CASE WHEN contains(field, 'employees') THEN 'employees: ' || coalesce(old_value, 'nothing') || ' -> ' || coalesce(new_value, 'nothing') WHEN contains(field, 'financials') THEN 'new annual accounts' WHEN contains(field, 'roles') THEN 'roles changed'
  WHEN contains(field, 'website') THEN 'website: ' || coalesce(old_value, 'nothing') || ' -> ' || coalesce(new_value, 'nothing') ELSE field || ' changed' END, '; ' ORDER BY field) AS notes, bool_and(content_sha256 IS NOT NULL) AS provenance FROM ch GROUP BY 1""")
def change_notes(spark, folder):
    """What changed between the first and the last available evidence on each module of a company."""
    rows = _evidence(spark, folder, "organisation_number", "field", "ingested_at", "value", "content_sha256").where("state = 'available' and organisation_number is not null")
    version = F.struct("ingested_at", "evidence_id", F.coalesce("value", F.lit("")).alias("v"), F.coalesce("content_sha256", F.lit("")).alias("h"))
    both = rows.groupBy("organisation_number", "field").agg(F.min(version).alias("a"), F.max(version).alias("b"))
    kept = lambda c: F.nullif(F.col(c), F.lit(""))
    changes = both.select("organisation_number", "field", kept("a.v").alias("old_value"), kept("b.v").alias("new_value"), kept("b.h").alias("content_sha256")).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return reports.change_notes(changes)


# Views and exports


@query(SQL["company_facts"].replace(f"WITH {_EVIDENCE}, k AS", f"WITH {_MODULE_STATES}, k AS") + " UNION ALL SELECT organisation_number, module, 'state', state, NULL, NULL, NULL FROM ms WHERE state <> 'available'")
def facts_and_states(spark, folder):
    return reports.facts_and_states(company_facts(spark, folder), _module_states(spark, folder))


_VIEWS = f"""{_MODULE_STATES}, {_JOB}, {_REGISTRY}, st AS (SELECT organisation_number, coalesce(bool_or(module = 'website' AND state = 'available'), false) AS has_website, count(*) FILTER (state = 'ambiguous') AS ambiguous, count(*) FILTER (state = 'failed') AS failed FROM ms GROUP BY 1),
nw AS (SELECT company_orgnr AS organisation_number, count(*) AS n FROM act GROUP BY 1), jb AS (SELECT company_orgnr AS organisation_number, count(*) AS n FROM job GROUP BY 1),
vw AS (SELECT reg.organisation_number, reg.name, reg.municipality, coalesce(has_website, false) AS has_website, coalesce(ambiguous, 0) AS ambiguous, coalesce(failed, 0) AS failed, coalesce(nw.n, 0) AS news, coalesce(jb.n, 0) AS jobs FROM reg LEFT JOIN st USING (organisation_number) LEFT JOIN nw ON nw.organisation_number = reg.organisation_number LEFT JOIN jb ON jb.organisation_number = reg.organisation_number)"""


def _views(spark, folder):
    return reports.company_views(_registry(spark, folder, "name", "municipality"), _module_states(spark, folder), _dated(spark, folder, "activities", "activity_id"), _dated(spark, folder, "jobs", "job_id"))


@query(f"WITH {_VIEWS} SELECT * FROM vw")
def company_views(spark, folder):
    return _views(spark, folder)


@query(f"""WITH {_VIEWS} SELECT 'all' AS view, count(*) AS n FROM vw UNION ALL SELECT 'website', count(*) FILTER (has_website) FROM vw UNION ALL SELECT 'news', count(*) FILTER (news > 0) FROM vw UNION ALL SELECT 'jobs', count(*) FILTER (jobs > 0) FROM vw
UNION ALL SELECT 'ambiguous', count(*) FILTER (ambiguous > 0) FROM vw UNION ALL SELECT 'failed', count(*) FILTER (failed > 0) FROM vw UNION ALL SELECT 'none', count(*) FILTER (NOT has_website AND news = 0 AND jobs = 0) FROM vw""")
def view_filters(spark, folder):
    counts = _views(spark, folder).agg(*(F.count_if(reports.view_filter(name)).alias(name) for name in reports.VIEW_FILTERS))
    return counts.select(F.explode(F.create_map(*(x for c in reports.VIEW_FILTERS for x in (F.lit(c), F.col(c))))).alias("view", "n"))


@query(f"WITH {_REGISTRY} SELECT organisation_number FROM reg WHERE contains(lower(concat_ws(' ', name, municipality)), 'helse')")
def view_search(spark, folder):
    return reports.found_in(_registry(spark, folder, "name", "municipality"), " Helse ", "name", "municipality").select("organisation_number")


_CASES = (("with a website", "companies with a website", "trim(coalesce(website, '')) <> ''"), ("large", "companies with at least 50 employees", "employees >= 50"), ("revenue", "companies with revenue over 5 million", "revenue > 5000000"), ("abstains", "companies with many reviews and a website", "false"), ("off by one", "companies with over 10 employees", "employees >= 10"))


@query(f"WITH {_SCREEN} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"case\", count(*) FILTER ({want}) AS expected, count(*) FILTER ({got}) AS found, count(*) FILTER (({want}) AND ({got})) AS \"both\", count(*) FILTER (coalesce(({want}), false) <> coalesce(({got}), false)) = 0 AS \"right\" FROM base"
    for name, _, want in _CASES for got in ["employees > 10" if name == "off by one" else want]))
def suite_scores(spark, folder):
    """Screens in words against conditions on the same companies; the last case is wrong on purpose."""
    base = _screen_base(spark, folder)
    return reports.suite_scores([(name, screen.run(base, screen.parse(words)), base.where(want)) for name, words, want in _CASES], "organisation_number")


@query(f"""WITH {_ENVELOPES}, t AS (SELECT organisation_number, min(legal_form) AS legal_form, min(industry_code) AS industry_code FROM fresh_companies WHERE organisation_number IS NOT NULL GROUP BY 1)
SELECT t.organisation_number, coalesce(env.state, 'missing') AS state, nullif(lower(trim(t.legal_form)), '') = nullif(lower(trim(reg.legal_form)), '') AS legal_form_agrees, nullif(lower(trim(t.industry_code)), '') = nullif(lower(trim(reg.industry_code)), '') AS industry_code_agrees FROM t LEFT JOIN env USING (organisation_number) LEFT JOIN reg ON reg.organisation_number = t.organisation_number""")
def against_truth(spark, folder):
    truth = load(spark, folder, "fresh_companies").where("organisation_number is not null").groupBy("organisation_number").agg(F.min("legal_form").alias("legal_form"), F.min("industry_code").alias("industry_code"))
    return reports.against_truth(_envelopes(spark, folder), _registry(spark, folder, "legal_form", "industry_code"), truth, "organisation_number", ["legal_form", "industry_code"])


# Synthesis


@query(f"""WITH {_ACT}, {_JOB}, {_ACCOUNTS}, e AS (SELECT company_orgnr AS organisation_number, {_day_sql("activity_date")} AS day, 'news' AS type, title, source_url FROM act
UNION ALL SELECT company_orgnr, {_day_sql("published_at")}, 'posting', job_title, source_url FROM job UNION ALL SELECT organisation_number, y || '-12-31', 'accounts', 'Annual accounts', NULL FROM fr WHERE place = 1),
d AS (SELECT DISTINCT * FROM e WHERE day IS NOT NULL AND day <= '{AS_OF}' AND organisation_number IS NOT NULL)
SELECT organisation_number, day, type, title, source_url, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY day DESC, type, title NULLS FIRST, source_url NULLS FIRST) AS place FROM d) WHERE place <= 20""")
def what_changed(spark, folder):
    news = _first(spark, folder, "activities", "activity_id", "company_orgnr", "activity_date", "title", "source_url").select(F.col("company_orgnr").alias("organisation_number"), days.day_of(F.col("activity_date")).alias("day"), "title", "source_url")
    jobs = _first(spark, folder, "jobs", "job_id", "company_orgnr", "published_at", "job_title", "source_url").select(F.col("company_orgnr").alias("organisation_number"), days.day_of(F.col("published_at")).alias("day"), F.col("job_title").alias("title"), "source_url")
    ends = official.accounts(_accounts(spark, folder), "organisation_number", "body", 1).select("organisation_number", F.col("period_to").alias("day"), F.lit("Annual accounts").alias("title"), F.lit(None).cast("string").alias("source_url"))
    return reports.what_changed([("news", news), ("posting", jobs), ("accounts", ends)], "organisation_number", F.lit(AS_OF))


_TREND = f"""{_ACCOUNTS}, yr AS (SELECT organisation_number, TRY_CAST(y AS INT) AS year, max(revenue) AS revenue FROM fa WHERE TRY_CAST(y AS INT) IS NOT NULL GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY year DESC) AS rn FROM yr),
kn AS (SELECT *, lead(revenue) OVER (PARTITION BY organisation_number ORDER BY year DESC) AS before, row_number() OVER (PARTITION BY organisation_number ORDER BY year DESC) AS k FROM rk WHERE rn <= 3 AND revenue IS NOT NULL),
tr AS (SELECT organisation_number, year, revenue, before, CASE WHEN before <> 0 THEN round_even((revenue - before) / abs(before) * 100, 1) END AS change_pct FROM kn WHERE k = 1)"""


def _trends(spark, folder):
    rows = official.accounts(_accounts(spark, folder), "organisation_number", "body", 1_000_000).select("organisation_number", "year", F.col("revenue").cast("bigint").alias("revenue"))
    return history.trend(rows, "organisation_number", "year", "revenue")


@query(f"""WITH {_REGISTRY}, {_TREND} SELECT reg.organisation_number, coalesce(name, 'The company') || ': ' || coalesce(nullif(concat_ws(' and ', CASE WHEN revenue IS NOT NULL THEN 'revenue of NOK ' || format('{{:,}}', revenue) || ' in ' || year || coalesce(CASE WHEN change_pct IS NOT NULL THEN ' (' || CASE WHEN change_pct >= 0 THEN 'up ' ELSE 'down ' END || format('{{:.1f}}', abs(CAST(change_pct AS DOUBLE))) || ' %)' END, '') END,
  CASE WHEN employees IS NOT NULL THEN employees || ' registered employees' END), ''), 'nothing known') || '.' AS summary FROM reg LEFT JOIN tr USING (organisation_number)""")
def company_summaries(spark, folder):
    return reports.summaries(_registry(spark, folder, "name", "employees"), _trends(spark, folder))


@query(f"WITH {_TREND} SELECT organisation_number, CASE WHEN change_pct >= 10 THEN 'growing' WHEN change_pct <= -10 THEN 'contracting' WHEN change_pct IS NOT NULL THEN 'steady' END AS outlook FROM tr")
def company_outlooks(spark, folder):
    from tindra.operators import synthesis

    rows = _trends(spark, folder)
    return rows.select("organisation_number", synthesis.outlook(rows).alias("outlook"))


# Observations

_HASHED = "CASE WHEN length({0}) = 64 THEN {0} ELSE sha256(concat_ws('|', '{1}', coalesce({2}, 'None'), coalesce({3}, 'None'))) END"
_OBSERVED = f"""{_ACT}, {_JOB}, {_EVIDENCE}, hp AS (SELECT company_orgnr, found_on_url FROM (SELECT company_orgnr, found_on_url, row_number() OVER (PARTITION BY company_orgnr ORDER BY count(*) DESC, found_on_url) AS rn FROM job WHERE found_on_url IS NOT NULL AND company_orgnr IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
md AS (SELECT organisation_number, field, source_url, content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number, field ORDER BY ingested_at DESC, evidence_id DESC) AS rn2 FROM ev WHERE state = 'available' AND value IS NOT NULL AND field IN ('financials', 'locations', 'roles', 'group')) WHERE rn2 = 1),
ob AS (SELECT 'job-' || job_id AS id, company_orgnr AS organisation_number, 'company_website' AS platform, 'job_posting' AS signal_type, source_url, {_HASHED.format("content_sha256", "job", "company_orgnr", "source_url")} AS content_sha256 FROM job
UNION ALL SELECT 'news-' || activity_id, company_orgnr, 'news', 'company_announcement', source_url, {_HASHED.format("content_sha256", "news", "company_orgnr", "source_url")} FROM act
UNION ALL SELECT 'hiring-' || company_orgnr, company_orgnr, 'company_website', 'hiring_signal', found_on_url, {_HASHED.format("CAST(NULL AS VARCHAR)", "hiring", "company_orgnr", "found_on_url")} FROM hp
UNION ALL SELECT field || '-' || organisation_number, organisation_number, CASE field WHEN 'financials' THEN 'official_accounts' ELSE 'official_registry' END, CASE field WHEN 'financials' THEN 'financial_statement' WHEN 'locations' THEN 'subunit' WHEN 'roles' THEN 'governance' ELSE 'group_structure' END, source_url,
  CASE WHEN length(content_sha256) = 64 THEN content_sha256 ELSE sha256(concat_ws('|', field, coalesce(organisation_number, 'None'), coalesce(source_url, 'None'))) END FROM md)"""


@query(f"WITH {_OBSERVED} SELECT * FROM ob WHERE organisation_number IS NOT NULL AND id IS NOT NULL")
def company_observations(spark, folder):
    """All observations of companies; the social adapters have nothing in the test tables and are tested on small frames."""
    jobs = _first(spark, folder, "jobs", "job_id", "company_orgnr", "job_title", "location", "source_url", "retrieved_at", "content_sha256", "found_on_url")
    news = _first(spark, folder, "activities", "activity_id", "company_orgnr", "activity_type", "title", "activity_date", "source_url", "retrieved_at", "content_sha256")
    known = _evidence(spark, folder, "organisation_number", "field", "ingested_at", "source_url", "retrieved_at", "content_sha256", "value")
    frames = [observations.registry_social(_registry(spark, folder, "website")), observations.site_news(news), observations.hiring(jobs), observations.hiring_page(jobs)]
    frames += [observations.from_module(known, field, *how) for field, how in observations.MODULES.items()]
    return observations.unite(frames).drop("retrieved_at", "metrics")


# Sources, lookups, scopes


@query(f"WITH {_REGISTRY} SELECT organisation_number, nullif(trim(name), '') AS name, nullif(trim(legal_form), '') AS legal_form, employees, coalesce(bankrupt, false) AS bankrupt, nullif(trim(municipality), '') AS municipality, nullif(trim(website), '') AS website FROM reg WHERE length(organisation_number) = 9")
def bulk_rows(spark, folder):
    """The registry written as a dump with the register's own column names, and read again."""
    rows = _registry(spark, folder, "name", "legal_form", "employees", "bankrupt", "municipality", "website")
    dump = rows.select(F.col("organisation_number").alias("organisasjonsnummer"), F.trim("name").alias("navn"), F.trim("legal_form").alias("organisasjonsform.kode"), F.col("employees").alias("antallAnsatte"), F.col("bankrupt").alias("konkurs"), F.trim("municipality").alias("forretningsadresse.kommune"), F.trim("website").alias("hjemmeside"))
    path = f"{shared_folder(spark).rstrip('/')}/dump-{spark.sparkContext.applicationId}"
    dump.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return bulk.read_bulk(spark, path).select("organisation_number", "name", "legal_form", "employees", "bankrupt", "municipality", "website")


@query(f"""WITH {_REGISTRY}, f AS (SELECT organisation_number, min(website) AS website, min(municipality) AS municipality FROM fresh_companies GROUP BY 1)
SELECT f.organisation_number, CASE WHEN trim(f.website) <> '' THEN f.website ELSE reg.website END AS website, CASE WHEN trim(f.municipality) <> '' THEN f.municipality ELSE reg.municipality END AS municipality FROM f LEFT JOIN reg USING (organisation_number)""")
def filled_gaps(spark, folder):
    fresh = load(spark, folder, "fresh_companies").groupBy("organisation_number").agg(F.min("website").alias("website"), F.min("municipality").alias("municipality"))
    return lookup.fill_gaps(fresh, _registry(spark, folder, "website", "municipality"), "organisation_number", ["website", "municipality"])


@query(f"WITH {_REGISTRY}, r AS (SELECT * FROM reg WHERE organisation_number IN (SELECT organisation_number FROM fresh_companies)) SELECT count(*) FILTER (website <> '') AS primary_rows, (SELECT count(DISTINCT organisation_number) FROM fresh_companies) - count(*) FILTER (website <> '') AS fallback_rows, CAST(0 AS BIGINT) AS missing_rows FROM r")
def resolution_counts(spark, folder):
    """How many of the requested companies each store resolved."""
    primary = _registry(spark, folder, "name", "website").where("coalesce(website, '') <> ''")
    found = lookup.with_fallback(_requested(spark, folder), [("registry", primary), ("fresh", load(spark, folder, "fresh_companies"))], "organisation_number", ["name"])
    return found.agg(F.count_if(F.col("source") == "registry").alias("primary_rows"), F.count_if(F.col("source") == "fresh").alias("fallback_rows"), F.count_if(F.col("source").isNull()).alias("missing_rows"))


@query(f"""WITH x AS (SELECT DISTINCT activity_id, source_url, found_on_url, {_HOST.format("found_on_url")} AS a, {_HOST.format("source_url")} AS b, {_PATH.format("found_on_url")} AS pa, {_PATH.format("source_url")} AS pb FROM activities WHERE found_on_url IS NOT NULL AND source_url IS NOT NULL)
SELECT activity_id, (b = a OR ends_with(b, '.' || a)) AND (pb = pa OR starts_with(pb, pa || '/')) AS in_scope FROM x""")
def scopes(spark, folder):
    rows = load(spark, folder, "activities").where("found_on_url is not null and source_url is not null").select("activity_id", "source_url", "found_on_url").distinct()
    return rows.select("activity_id", urls.in_scope(F.col("found_on_url"), F.col("source_url")).alias("in_scope"))


@query("""WITH p AS (SELECT DISTINCT organisation_number, 'REG-' || substring(sha256(concat_ws('|', organisation_number, coalesce(field, 'None'))), 1, 16) AS module_id FROM evidence WHERE organisation_number IS NOT NULL) SELECT organisation_number, count(*) AS modules, min(module_id) AS first_id FROM p GROUP BY 1""")
def module_ids(spark, folder):
    rows = load(spark, folder, "evidence").where("organisation_number is not null").select("organisation_number", short_id("REG-", F.col("organisation_number"), F.col("field")).alias("module_id")).distinct()
    return rows.groupBy("organisation_number").agg(F.count("*").alias("modules"), F.min("module_id").alias("first_id"))


@query("SELECT fetch_id, rank, 'https://' || host || '/' || rank AS url, host AS title FROM (SELECT fetch_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest([1, 2]) AS rank FROM (SELECT DISTINCT fetch_id, url FROM fetch_results WHERE url IS NOT NULL))")
def search_answers(spark, folder):
    """Results of search answers that are put together from the addresses of the fetches."""
    rows = load(spark, folder, "fetch_results").where("url is not null").select("fetch_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("h")).distinct()
    item = lambda k: F.struct(F.concat(F.lit("https://"), "h", F.lit(f"/{k}")).alias("url"), F.col("h").alias("title"), F.lit("text").alias("description"))
    answers = rows.select("fetch_id", F.to_json(F.struct(F.struct(F.array(item(1), item(2)).alias("results")).alias("web"))).alias("body"))
    return extract.search_results(answers, "fetch_id", "body").select("fetch_id", "rank", "url", "title")


@query("""WITH b AS (SELECT activity_id, string_split(lower(regexp_replace(coalesce(title, ''), '[^0-9A-Za-z]+', ' ', 'g')), ' ') AS w FROM (SELECT DISTINCT activity_id, title FROM activities)) SELECT activity_id, len(list_filter(range(1, greatest(len(w), 1)), lambda k: w[k] = 'ny' AND w[k + 1] = 'avtale')) > 0 AS has_phrase, len(list_intersect(list_distinct(w), ['ny', 'avtale', 'og'])) AS shared FROM b""")
def phrases_in_titles(spark, folder):
    words = F.split(F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), "[^0-9A-Za-z]+", " ")), " ")
    rows = load(spark, folder, "activities").select("activity_id", "title").distinct().withColumn("w", words)
    lits = lambda *ws: F.array(*(F.lit(w) for w in ws))
    return rows.select("activity_id", text.has_phrase(F.col("w"), lits("ny", "avtale")).alias("has_phrase"), text.overlap(F.col("w"), lits("ny", "avtale", "og")).alias("shared"))


@query(f"""WITH {_EVIDENCE}, {_SCREEN}, f AS (SELECT organisation_number FROM base WHERE trim(coalesce(website, '')) <> '' AND revenue > 5000000)
SELECT organisation_number, field AS module, source_url, retrieved_at, content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number, field ORDER BY ingested_at DESC, evidence_id DESC) AS rn3 FROM ev WHERE state = 'available' AND field IN ('financials', 'website') AND organisation_number IN (SELECT organisation_number FROM f)) WHERE rn3 = 1""")
def screen_citations(spark, folder):
    """What the companies with a website and more than 5 million of revenue rest on."""
    plan = screen.parse("companies with a website and revenue over 5 million")
    known = _evidence(spark, folder, "organisation_number", "field", "ingested_at", "source_url", "retrieved_at", "content_sha256")
    return screen.cited(screen.run(_screen_base(spark, folder), plan), known, plan)
