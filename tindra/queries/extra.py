"""Queries of titles, kinds, observations' rules, coverage, and what two deliveries say beside claims, jobs and activities."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.functions import names, text, urls
from tindra.operators import aggregates, evidence, extract, history, identity, ranking, sampling, synthesis
from tindra.queries.core import _BAND, _EVIDENCE, _HOST, _PAIRS_OF_DELIVERIES, _REGISTRY, AS_OF, _evidence, _registry, _sides, query
from tindra.queries.more import _ACT, _COMPACT, _JOB, _LIST, _TOKENS, _first, result_scores
from tindra.queries.more import SQL_OF_RESULTS as _RESULTS
from tindra.queries.overview import _OBSERVED, _TREND, _trends, company_observations
from tindra.tables import load

_ONE_LINE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_HEAD = _ONE_LINE.format("title")
for _cut in text.HEADLINE_CUTS:
    _HEAD = f"regexp_replace({_HEAD}, '(?i){_cut}', '')"


@query(f"WITH t AS (SELECT DISTINCT activity_id, trim({_HEAD}) AS b FROM (SELECT DISTINCT activity_id, title FROM activities)) SELECT activity_id, CASE WHEN length(b) >= 4 AND NOT list_contains({_LIST(text.SECTION_TITLES)}, lower(b)) THEN substring(b, 1, 300) END AS headline FROM t")
def headlines(spark, folder):
    return load(spark, folder, "activities").select("activity_id", "title").distinct().select("activity_id", text.headline(F.col("title")).alias("headline")).distinct()


@query(f"WITH t AS (SELECT DISTINCT job_id, trim(regexp_replace(regexp_replace({_ONE_LINE.format('job_title')}, '^[-–—•*|:]+[ ]*', ''), '[ ]*[-–—•*|:]+$', '')) AS b FROM jobs) SELECT job_id, CASE WHEN length(b) >= 3 AND NOT list_contains({_LIST(text.CAREER_TITLES)}, lower(b)) THEN substring(b, 1, 200) END AS title FROM t")
def posting_titles(spark, folder):
    return load(spark, folder, "jobs").select("job_id", text.posting_title(F.col("job_title")).alias("title")).distinct()


@query(f"WITH {_ACT} SELECT activity_id, CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', title, description)), '{p}') THEN '{name}'" for name, p in text.ACTIVITY_KINDS) + " ELSE 'company_update' END AS kind FROM act")
def activity_types(spark, folder):
    return _first(spark, folder, "activities", "activity_id", "title", "description").select("activity_id", text.activity_kind(F.col("title"), F.col("description")).alias("kind"))


@query(f"WITH {_ACT}, {_REGISTRY}, m AS (SELECT activity_id, company_orgnr, {_HOST.format('source_url')} AS publisher, {_TOKENS.format('title')} AS tw, {_TOKENS.format('reg.name')} AS nw, title FROM act JOIN reg ON reg.organisation_number = company_orgnr WHERE title IS NOT NULL),"
       " h AS (SELECT * FROM m WHERE len(nw) > 0 AND len(list_filter(range(1, greatest(len(tw) - len(nw) + 1, 1) + 1), lambda k: tw[k:k + len(nw) - 1] = nw)) > 0)"
       " SELECT activity_id, company_orgnr FROM (SELECT *, row_number() OVER (PARTITION BY company_orgnr, title, publisher ORDER BY activity_id) AS rn FROM h) WHERE rn = 1")  # fmt: skip
def title_mentions(spark, folder):
    """Articles whose title holds the whole name of the company in a row; of one title by one publisher the first."""
    rows = _first(spark, folder, "activities", "activity_id", "company_orgnr", "title", "source_url").where("title is not null")
    joined = rows.join(_registry(spark, folder, "name").withColumnRenamed("organisation_number", "company_orgnr"), "company_orgnr").withColumn("publisher", urls.host(F.col("source_url")))
    hit = joined.where(text.has_phrase(text.tokens(F.col("title")), text.tokens(F.col("name"))))
    best = hit.groupBy("company_orgnr", "title", "publisher").agg(F.min("activity_id").alias("activity_id"))
    return best.select("activity_id", "company_orgnr")


@query(f"""WITH {_ACT} SELECT company_orgnr, activity_type AS platform, count(*) AS items, count(DISTINCT source_url) AS distinct_urls, count(*) FILTER (coalesce(identity_assessment.score >= 0.9, false)) AS accepted,
  count(*) FILTER (epoch(TIMESTAMP '{AS_OF} 00:00:00') - floor(epoch(ingested_at)) BETWEEN 0 AND 45 * 86400) AS fresh FROM act GROUP BY 1, 2""")
def platform_footprints(spark, folder):
    rows = ranking.keep_first(load(spark, folder, "activities").select("activity_id", "company_orgnr", "activity_type", "source_url", "identity_assessment", "ingested_at"), ["activity_id"], [F.col("ingested_at")])
    return aggregates.by_platform(rows, "company_orgnr", "activity_type", "source_url", F.col("identity_assessment.score") >= 0.9, F.col("ingested_at").cast("timestamp"), F.lit(f"{AS_OF} 00:00:00").cast("timestamp"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'view') AS neutral, count(*) FILTER (event_type = 'error') AS negative, CAST(sum(CASE WHEN value >= 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS engagement FROM events GROUP BY 1")
def label_counts(spark, folder):
    return aggregates.label_counts(load(spark, folder, "events"), "user_id", "event_type", {"positive": "purchase", "neutral": "view", "negative": "error"}, F.when(F.col("value") >= 0, F.floor("value").cast("bigint")))


@query(f"""WITH {_EVIDENCE}, {_JOB}, {_ACT}, {_REGISTRY} SELECT 'registry' AS what, count(DISTINCT organisation_number) AS companies, count(*) AS items FROM ev WHERE field = 'registry' AND state = 'available'
UNION ALL SELECT 'financials', count(DISTINCT organisation_number), count(*) FROM ev WHERE field = 'financials' AND state = 'available' UNION ALL SELECT 'jobs', count(DISTINCT company_orgnr), count(*) FROM job UNION ALL SELECT 'news', count(DISTINCT company_orgnr), count(*) FROM act UNION ALL SELECT 'website', count(DISTINCT organisation_number), count(*) FROM reg WHERE coalesce(website, '') <> ''""")
def coverage(spark, folder):
    known = _evidence(spark, folder, "organisation_number", "field").where("state = 'available'")
    frames = {"registry": known.where("field = 'registry'"), "financials": known.where("field = 'financials'"), "jobs": _first(spark, folder, "jobs", "job_id", "company_orgnr").withColumnRenamed("company_orgnr", "organisation_number"), "news": _first(spark, folder, "activities", "activity_id", "company_orgnr").withColumnRenamed("company_orgnr", "organisation_number"), "website": _registry(spark, folder, "website").where("coalesce(website, '') <> ''")}
    return aggregates.coverage(frames, "organisation_number")


_PLATFORM_NAMES, _SIGNALS = ("news", "company_website", "official_accounts", "official_registry"), ("company_announcement", "job_posting", "hiring_signal", "financial_statement", "subunit", "governance", "group_structure")


@query(f"""WITH {_OBSERVED} SELECT violated, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT coalesce(trim(id) <> '', false) THEN 'id' END, CASE WHEN NOT coalesce(regexp_matches(organisation_number, '^[0-9]{{9}}$'), false) THEN 'organisation_number' END, CASE WHEN NOT coalesce(list_contains({_LIST(_PLATFORM_NAMES)}, platform), false) THEN 'platform' END,
  CASE WHEN NOT coalesce(list_contains({_LIST(_SIGNALS)}, signal_type), false) THEN 'signal_type' END, CASE WHEN NOT coalesce(regexp_matches(source_url, '^https?://[^/ ]+\\.[^/ ]+'), false) THEN 'source_url' END, CASE WHEN NOT coalesce(regexp_matches(content_sha256, '^[0-9a-f]{{64}}$'), false) THEN 'content_hash' END], lambda x: x IS NOT NULL), ',') AS violated FROM ob WHERE organisation_number IS NOT NULL AND id IS NOT NULL) GROUP BY 1""")
def observation_violations(spark, folder):
    broken = evidence.violations(evidence.observation_rules(_PLATFORM_NAMES, _SIGNALS))
    return company_observations(spark, folder).groupBy(F.array_join(broken, ",").alias("violated")).agg(F.count("*").alias("n"))


@query(f"""WITH {_REGISTRY} SELECT coalesce(legal_form, 'none') || '|' || {_BAND} || '|' || coalesce(nullif(string_split(industry_code, '.')[1], ''), 'none') || '|' || coalesce(nullif(substring(municipality_number, 1, 2), ''), 'none') || '|' || CASE WHEN coalesce(website, '') <> '' THEN 'web' ELSE 'no web' END AS stratum, count(*) AS n FROM reg GROUP BY 1""")
def filer_strata(spark, folder):
    rows = _registry(spark, folder, "legal_form", "employees", "industry_code", "municipality_number", "website")
    web = F.when(F.coalesce("website", F.lit("")) != "", "web").otherwise("no web")
    stratum = sampling.stratum(F.col("legal_form"), sampling.size_band(F.col("employees")), text.filled(F.substring_index("industry_code", ".", 1)), text.filled(F.substring("municipality_number", 1, 2)), web)
    return rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))


@query(f"""WITH {_JOB}, p AS (SELECT company_orgnr, found_on_url, min(ingested_at) AS o FROM job WHERE found_on_url IS NOT NULL AND company_orgnr IS NOT NULL GROUP BY 1, 2)
SELECT company_orgnr, found_on_url, kind FROM (SELECT *, row_number() OVER (PARTITION BY company_orgnr ORDER BY CASE kind WHEN 'careers' THEN 0 WHEN 'homepage' THEN 1 ELSE 2 END, o, found_on_url) AS rn FROM (SELECT *, CASE WHEN regexp_matches(lower(found_on_url), '/(karriere|jobb|jobs|careers|stilling|stillinger|ledige-stillinger|vacancies)(/|$)') THEN 'careers' WHEN regexp_matches(found_on_url, '^https?://[^/]+/?$') THEN 'homepage' ELSE 'other' END AS kind FROM p)) WHERE rn = 1""")
def hiring_pages(spark, folder):
    """Of each company the page that speaks for its hiring: a careers page before the home page before others, then the first seen."""
    rows = _first(spark, folder, "jobs", "job_id", "company_orgnr", "found_on_url").where("found_on_url is not null and company_orgnr is not null")
    first = ranking.keep_first(load(spark, folder, "jobs").select("job_id", "ingested_at"), ["job_id"], [F.col("ingested_at")])
    pages = rows.join(first, "job_id").groupBy("company_orgnr", "found_on_url").agg(F.min("ingested_at").alias("o"))
    u = F.col("found_on_url")
    kind = F.when(F.lower(u).rlike("/(" + "|".join(urls.CAREER_WORDS) + ")(/|$)"), "careers").when(u.rlike("^https?://[^/]+/?$"), "homepage").otherwise("other")
    rank = F.when(kind == "careers", 2).when(kind == "homepage", 1).otherwise(0)
    return ranking.best_of(pages.withColumn("kind", kind), ["company_orgnr"], rank, [F.col("o"), u]).select("company_orgnr", "found_on_url", "kind")


@query(f"WITH r AS ({_RESULTS}), c AS (SELECT DISTINCT candidate_id, rank FROM candidates) SELECT organisation_number, candidate_id, score FROM (SELECT r.*, row_number() OVER (PARTITION BY organisation_number ORDER BY score DESC, c.rank, candidate_id) AS rn FROM r JOIN c USING (candidate_id) WHERE status <> 'rejected') WHERE rn = 1")
def picked_results(spark, folder):
    """Of each company the search result of the best score, of equal ones the first in rank."""
    ranks = load(spark, folder, "candidates").select("candidate_id", "rank").distinct()
    rows = result_scores(spark, folder).where("status <> 'rejected'").join(ranks, "candidate_id")
    return ranking.best_of(rows, ["organisation_number"], F.col("score"), [F.col("rank"), F.col("candidate_id")]).select("organisation_number", "candidate_id", "score")


# Deliveries

_LAST = f"WITH {_PAIRS_OF_DELIVERIES}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_no, organisation_number ORDER BY captured_at DESC NULLS LAST, snapshot_id DESC NULLS LAST) AS rn FROM snapshots) WHERE rn = 1 AND organisation_number IS NOT NULL)"


@query(f"""{_LAST}, u AS (SELECT DISTINCT delivery_no, organisation_number, u.url AS url FROM (SELECT delivery_no, organisation_number, unnest(sources) AS u FROM s) WHERE u.url IS NOT NULL)
SELECT w.d AS delivery_no, u.organisation_number, url FROM u JOIN w ON u.delivery_no = w.d WHERE w.before IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.delivery_no = w.before AND s.organisation_number = u.organisation_number) AND NOT EXISTS (SELECT 1 FROM u AS v WHERE v.delivery_no = w.before AND v.organisation_number = u.organisation_number AND v.url = u.url)""")
def new_sources(spark, folder):
    """Sources that a company's delivery has and the one before has not, for companies that are in both."""
    before, after = _sides(spark, folder, "sources")
    listed = lambda side: side.select("delivery_no", "organisation_number", F.explode("sources").alias("s")).select("delivery_no", "organisation_number", "s.url").where("url is not null and organisation_number is not null").distinct()
    return history.added(listed(before), listed(after), before.select("delivery_no", "organisation_number"), ["delivery_no", "organisation_number"], ["url"])


@query(f"""{_LAST}, i AS (SELECT delivery_no, organisation_number, 'job' AS entity_type, j.job_id AS entity_key, j.posted_date AS day FROM (SELECT delivery_no, organisation_number, unnest(jobs) AS j FROM s) UNION ALL SELECT delivery_no, organisation_number, 'activity', a.activity_id, a.activity_date FROM (SELECT delivery_no, organisation_number, unnest(activities) AS a FROM s)),
k AS (SELECT delivery_no, organisation_number, entity_type, entity_key, max(day) AS day FROM i WHERE entity_key IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT w.d AS delivery_no, k.organisation_number, entity_type, entity_key, CASE WHEN regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substring(day, 1, 10) END AS effective_date FROM k JOIN w ON k.delivery_no = w.d
WHERE w.before IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.delivery_no = w.before AND s.organisation_number = k.organisation_number) AND NOT EXISTS (SELECT 1 FROM k AS v WHERE v.delivery_no = w.before AND v.organisation_number = k.organisation_number AND v.entity_type = k.entity_type AND v.entity_key = k.entity_key)""")
def dated_additions(spark, folder):
    """Jobs and activities that came with a delivery, with the day that they state themselves."""
    before, after = _sides(spark, folder, "jobs", "activities")

    def items(side):
        of = lambda c, kind, key, day: side.select("delivery_no", "organisation_number", F.explode(c).alias("i")).select("delivery_no", "organisation_number", F.lit(kind).alias("entity_type"), F.col(f"i.{key}").alias("entity_key"), F.col(f"i.{day}").alias("day"))
        rows = of("jobs", "job", "job_id", "posted_date").unionByName(of("activities", "activity", "activity_id", "activity_date"))
        return rows.where("entity_key is not null and organisation_number is not null").groupBy("delivery_no", "organisation_number", "entity_type", "entity_key").agg(F.max("day").alias("day"))

    found = history.added(items(before), items(after), before.select("delivery_no", "organisation_number"), ["delivery_no", "organisation_number"], ["entity_type", "entity_key"], ["day"])
    return found.select("delivery_no", "organisation_number", "entity_type", "entity_key", F.when(F.col("day").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring("day", 1, 10)).alias("effective_date"))


@query(f"""{_LAST}, c AS (SELECT delivery_no, organisation_number, e.key AS k, e.value AS v FROM (SELECT delivery_no, organisation_number, unnest(map_entries(claims)) AS e FROM s) WHERE e.value IS NOT NULL AND e.key NOT IN ('retrieved_at', 'captured_at', 'query_time')),
t AS (SELECT delivery_no, organisation_number, string_agg(k || '=' || v, chr(10) ORDER BY k) AS x FROM c GROUP BY 1, 2)
SELECT s.delivery_no, s.organisation_number, sha256(coalesce(x, '')) AS profile_hash, 'snap-' || substring(sha256(s.organisation_number || '|' || coalesce(CAST(s.delivery_no AS VARCHAR), 'None') || '|' || sha256(coalesce(x, ''))), 1, 16) AS snapshot_key FROM s LEFT JOIN t ON t.delivery_no IS NOT DISTINCT FROM s.delivery_no AND t.organisation_number = s.organisation_number""")
def snapshot_keys(spark, folder):
    """A hash of each delivery of a company's claims that does not depend on their order, and the key made of it."""
    rows = load(spark, folder, "snapshots").where("organisation_number is not null").select("delivery_no", "organisation_number", F.struct("captured_at", "snapshot_id").alias("at"), "claims")
    last = evidence.latest_of_key(rows, ["delivery_no", "organisation_number"], F.col("at"))
    return history.keyed(last, "organisation_number", "delivery_no", "claims").select("delivery_no", "organisation_number", "profile_hash", "snapshot_key")


@query(f"""WITH {_TREND}, {_JOB}, {_ACT}, n AS (SELECT company_orgnr AS o, count(*) AS n FROM act WHERE company_orgnr IS NOT NULL AND epoch(TIMESTAMP '{AS_OF} 00:00:00') - floor(epoch(ingested_at)) BETWEEN 0 AND 365 * 86400 GROUP BY 1), p AS (SELECT company_orgnr AS o, count(*) AS n FROM job WHERE company_orgnr IS NOT NULL GROUP BY 1)
SELECT organisation_number, 'growing' AS statement, 'revenue_trend' AS basis FROM tr WHERE change_pct >= 10 UNION ALL SELECT organisation_number, 'contracting', 'revenue_trend' FROM tr WHERE change_pct <= -10 UNION ALL SELECT o, 'recruiting', 'job_postings' FROM p UNION ALL SELECT o, 'publishing', 'recent_news' FROM n WHERE n >= 2""")
def inferences(spark, folder):
    """What the signals of a company let one conclude, and from which."""
    news = _first_dated(spark, folder, "activities", "activity_id")
    age = F.unix_timestamp(F.lit(f"{AS_OF} 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ingested_at").cast("timestamp"))
    recent = news.where(age.between(0, 365 * 86_400)).groupBy("organisation_number").agg(F.count("*").alias("n"))
    postings = _first_dated(spark, folder, "jobs", "job_id").groupBy("organisation_number").agg(F.count("*").alias("n"))
    return synthesis.inferences(_trends(spark, folder), postings, recent)


def _first_dated(spark, folder, table, key) -> DataFrame:
    rows = ranking.keep_first(load(spark, folder, table).select(key, "company_orgnr", "ingested_at"), [key], [F.col("ingested_at")])
    return rows.where("company_orgnr is not null").withColumnRenamed("company_orgnr", "organisation_number")


# Identity

_ELEMENT = r"CASE WHEN regexp_extract(b, '(?is)<title\b[^>]*>(.*?)</title>', 1) <> '' THEN trim(regexp_replace(replace(regexp_replace(regexp_extract(b, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) END"
_ROOT0 = "regexp_replace(coalesce(CASE WHEN len(lab) >= sz THEN lab[len(lab) - sz + 1] END, ''), '[^a-z0-9]', '', 'g')"
_ON = "coalesce({0} <> '' AND (host = {0} OR ends_with(host, '.' || {0})), false)"
_IDENTITY = f"""{_REGISTRY}, i0 AS (SELECT DISTINCT fetch_id, organisation_number, url, body, regexp_replace(regexp_replace(body, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g') AS b FROM fetch_results WHERE status = 200 AND body IS NOT NULL),
i1 AS (SELECT i0.*, {_ELEMENT} AS title, reg.name, reg.email, reg.municipality, reg.website, reg.phone, reg.business_address.adresse AS street, reg.business_address.postnummer AS code, {_HOST.format("url")} AS host FROM i0 JOIN reg USING (organisation_number)),
i2 AS (SELECT *, {_TOKENS.format("coalesce(name, '')")} AS w, {_TOKENS.format("concat_ws(' ', title, b)")} AS said, {_TOKENS.format("coalesce(title, '')")} AS tw, coalesce(lower(regexp_extract(email, '@([^@\\s>]+)$', 1)), '') AS mail, {_HOST.format("website")} AS own, string_split(host, '.') AS lab,
  CASE WHEN regexp_matches(host, '(^|\\.)({"|".join(x.replace(".", "[.]") for x in names.LONG_SUFFIXES)})$') THEN 3 ELSE 2 END AS sz, regexp_replace(regexp_replace(body, '([0-9])[ .]([0-9]{{3}})', '\\1\\2', 'g'), '([0-9])[ .]([0-9]{{3}})', '\\1\\2', 'g') AS plain, {_COMPACT.format("concat_ws(' ', title, body)")} AS flat, {_COMPACT.format("regexp_replace(coalesce(title, ''), '\\s[|»–-]\\s.*$', '')")} AS head,
  regexp_replace(coalesce(organisation_number, ''), '[^0-9]', '', 'g') AS num, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS tel, {_COMPACT.format("coalesce(street, '')")} AS st, {_COMPACT.format("coalesce(municipality, '')")} AS pl FROM i1),
i3 AS (SELECT *, CASE WHEN length({_ROOT0}) < 3 OR list_contains({_LIST(names.HOSTING)}, {_ROOT0}) THEN '' ELSE {_ROOT0} END AS root, list_filter(regexp_extract_all(plain, '[0-9]+'), lambda x: length(x) = 9) AS nums, array_to_string(w, '') AS joined, {_TOKENS.format("translate(coalesce(name, ''), 'æÆ', 'aA')")} AS w2 FROM i2),
i4 AS (SELECT *, len(w) AS n, len(list_intersect(list_distinct(w), said)) AS shared, joined <> '' AND contains({_COMPACT.format("coalesce(title, '')")}, joined) AS whole, len(w) > 0 AND (head = joined OR head = {_COMPACT.format("coalesce(name, '')")}) AS exact, coalesce(len(w) > 0 AND contains(regexp_replace(host, '[^a-z0-9]', '', 'g'), array_to_string(w[1:2], '')), false) AS inhost,
  {_ON.format("mail")} AS bymail, {_ON.format("own")} AS bysite, len(list_filter(tw, lambda x: length(x) >= 4 AND contains(root, x))) > 0 AS brand,
  CASE WHEN root <> '' AND array_to_string(list_filter(w, lambda x: contains(root, x)), '') = root THEN list_filter(w, lambda x: NOT contains(root, x)) WHEN root <> '' AND array_to_string(list_filter(w2, lambda x: contains(root, x)), '') = root THEN list_filter(w2, lambda x: NOT contains(root, x)) ELSE [] END AS rest,
  list_contains(nums, num) AS mine, len(list_filter(nums, lambda x: x <> num)) > 0 AS rival, length(tel) >= 8 AND contains(regexp_replace(plain, '[^0-9]', '', 'g'), right(tel, 8)) AS phoned, length(st) >= 6 AND contains(flat, st) AS street_said, coalesce(regexp_matches(code, '^[0-9]{{4}}$') AND contains(body, code), false) AS coded, pl <> '' AND contains(flat, pl) AS placed,
  coalesce(regexp_matches(title, '{identity.ERROR_WORDS}'), false) AS err, coalesce(regexp_matches(title, '{identity.PARKED_WORDS}'), false) AS parked, length(body) >= 100 AS big FROM i3),
i5 AS (SELECT *, len(list_filter(rest, lambda x: list_contains({_LIST(names.BRANCHES)}, x) OR list_contains({_TOKENS.format("coalesce(municipality, '')")}, x))) > 0 AS branch, shared / greatest(n, 1) AS ratio, street_said OR (coded AND placed) AS strong FROM i4)"""
_SCORES = """CASE WHEN err THEN 0.1 WHEN parked THEN 0.1 WHEN mine AND NOT rival THEN 1.0 WHEN rival AND NOT mine THEN 0.2 WHEN bysite AND bymail AND NOT rival THEN 0.92 WHEN NOT bysite AND NOT bymail AND inhost AND shared = 0 THEN 0.85
  WHEN exact AND (bysite OR bymail OR inhost) AND (n >= 2 OR big) THEN 0.95 WHEN exact THEN 0.85 WHEN (ratio >= 0.75 AND strong) OR (phoned AND shared >= 1) THEN 0.95 WHEN bymail AND shared >= 1 THEN 0.95 WHEN bysite AND brand AND big THEN 0.9 WHEN bysite AND branch AND big THEN 0.9
  WHEN whole AND placed THEN 0.95 WHEN whole AND inhost AND big THEN 0.92 WHEN whole THEN 0.85 WHEN ratio >= 0.75 AND shared >= 2 AND placed THEN 0.9 WHEN ratio >= 0.75 AND shared >= 2 THEN 0.85 WHEN ratio >= 0.5 AND shared >= 2 THEN 0.65 ELSE 0.3 END"""


@query(f"WITH {_IDENTITY} SELECT fetch_id, organisation_number, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'exact' WHEN score >= 0.8 THEN 'review' ELSE 'uncertain' END AS status FROM (SELECT fetch_id, organisation_number, {_SCORES} AS score FROM i5)")
def identity_rules(spark, folder):
    """Each fetched page against the company it was fetched for: features, then the first rule that holds."""
    pages = load(spark, folder, "fetch_results").where("status = 200 and body is not null").select("fetch_id", "organisation_number", "url", "body").distinct()
    title = extract.title_of(F.col("body"))
    companies = _registry(spark, folder, "name", "email", "municipality", "website", "phone", "business_address").select("organisation_number", "name", "email", "municipality", "website", "phone", F.col("business_address.adresse").alias("street"), F.col("business_address.postnummer").alias("code"))
    joined = pages.withColumn("title", title).join(companies, "organisation_number")
    features = identity.with_features(joined, "name", "organisation_number", "email", "municipality", "url", "title", "body", "website", "phone", "street", "code")
    return identity.assess(features).select("fetch_id", "organisation_number", "score", "status")
