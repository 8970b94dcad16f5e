"""Further queries of the core operators over the test tables: extraction, names, candidates, observations, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tindra.functions import days, names, text, urls
from tindra.operators import candidates, extract, identity, official, ranking
from tindra.queries.core import _CANONICAL, _EVIDENCE, _FOLD, _HOST, _PATH, _REGISTRY, _evidence, _registry, query
from tindra.tables import load

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SEGMENTS = "list_filter(string_split(lower(" + _PATH + "), '/'), lambda s: s <> '')"
_TOKENS = "list_filter(regexp_extract_all(" + _FOLD + ", '([a-z0-9]+)', 1), lambda x: length(x) > 1 AND NOT list_contains(" + _LIST(text.LEGAL_WORDS) + ", x))"
_COMPACT = "regexp_replace(" + _FOLD + ", '[^a-z0-9]', '', 'g')"
_ACT = "act AS (SELECT DISTINCT ON (activity_id) * FROM activities ORDER BY activity_id, ingested_at)"
_JOB = "job AS (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, ingested_at)"


def _made_sql(y: str, m: str, d: str) -> str:
    return f"CASE WHEN TRY_CAST({m} AS INT) BETWEEN 1 AND 12 AND TRY_CAST({d} AS INT) BETWEEN 1 AND 31 THEN format('{{:04d}}-{{:02d}}-{{:02d}}', TRY_CAST({y} AS INT), TRY_CAST({m} AS INT), TRY_CAST({d} AS INT)) END"


def _day_sql(c: str) -> str:
    x = lambda p, k: f"regexp_extract({c}, '{p}', {k})"
    month = "CASE " + " ".join(f"WHEN list_contains({_LIST(n)}, lower({x(days.NAMED, 2)})) THEN '{k}'" for k, n in days.MONTHS.items()) + " ELSE '' END"
    return f"coalesce(nullif({x(days.ISO, 1)}, ''), {_made_sql(x(days.NUMBERS, 3), x(days.NUMBERS, 2), x(days.NUMBERS, 1))}, {_made_sql(x(days.NAMED, 3), month, x(days.NAMED, 1))})"


def _first(spark, folder, table, key, *columns):
    """One row of each key: the first to arrive."""
    rows = load(spark, folder, table).select(key, "ingested_at", *columns)
    return ranking.keep_first(rows, [key], [F.col("ingested_at")]).drop("ingested_at")


# Names, addresses, days

_ROOT = "CASE WHEN length(root0) < 3 OR list_contains(" + _LIST(names.HOSTING) + ", root0) THEN '' ELSE root0 END"
_NAMED = f"""{_REGISTRY}, r0 AS (SELECT organisation_number, coalesce(name, '') AS name, coalesce(municipality, '') AS municipality, string_split({_HOST.format("website")}, '.') AS labels, {_HOST.format("website")} AS host FROM reg),
r1 AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)({"|".join(s.replace(".", "[.]") for s in names.LONG_SUFFIXES)})$') THEN 3 ELSE 2 END AS size FROM r0),
r2 AS (SELECT *, CASE WHEN len(labels) >= size THEN array_to_string(labels[len(labels) - size + 1:], '.') END AS domain FROM r1),
r3 AS (SELECT *, regexp_replace(coalesce(string_split(domain, '.')[1], ''), '[^a-z0-9]', '', 'g') AS root0 FROM r2),
r4 AS (SELECT *, {_ROOT} AS root, {_TOKENS.format("name")} AS words, {_TOKENS.format("translate(name, 'æÆ', 'aA')")} AS words2 FROM r3),
r5 AS (SELECT *, list_filter(words, lambda w: contains(root, w)) AS s1, list_filter(words2, lambda w: contains(root, w)) AS s2 FROM r4),
r6 AS (SELECT *, CASE WHEN root <> '' AND array_to_string(s1, '') = root THEN s1 WHEN root <> '' AND array_to_string(s2, '') = root THEN s2 ELSE [] END AS spelled,
  CASE WHEN root <> '' AND array_to_string(s1, '') = root THEN list_filter(words, lambda w: NOT contains(root, w)) WHEN root <> '' AND array_to_string(s2, '') = root THEN list_filter(words2, lambda w: NOT contains(root, w)) ELSE words END AS rest FROM r5)"""


@query(f"""WITH {_NAMED}, f AS (SELECT *, list_filter(regexp_extract_all({_FOLD.format("replace(name, '&', ' ')")}, '([a-z0-9]+)', 1), lambda x: NOT list_contains({_LIST(names.LEGAL_ENDINGS)}, x)) AS k FROM r6),
g AS (SELECT *, CASE WHEN len(k) >= 2 AND k[-2:] = ['a', 's'] THEN k[:-3] ELSE k END AS k2 FROM f)
SELECT organisation_number, array_to_string(CASE WHEN len(k2) >= 2 AND k2[1:2] = ['a', 's'] THEN k2[3:] ELSE k2 END, ' ') AS full_words, domain, root,
  array_to_string(spelled, ' ') AS spelled, array_to_string(list_filter(words, lambda w: NOT contains(root, w)), ' ') AS specific,
  len(spelled) > 0 AND len(list_filter(rest, lambda w: list_contains({_LIST(names.BRANCHES)}, w) OR list_contains({_TOKENS.format("municipality")}, w))) > 0 AS is_branch FROM g""")
def name_parts(spark, folder):
    rows = _registry(spark, folder, "name", "municipality", "website").withColumn("root", names.site_root(F.col("website")))
    said = names.spelled_by_site(F.coalesce("name", F.lit("")), F.col("root"))
    join = lambda c: F.array_join(c, " ")
    return rows.select(
        "organisation_number", join(names.full_words(F.col("name"))).alias("full_words"), names.registered_domain(F.col("website")).alias("domain"), "root", join(said["spelled"]).alias("spelled"),
        join(names.specific_words(F.coalesce("name", F.lit("")), F.col("root"))).alias("specific"), names.is_branch(F.coalesce("name", F.lit("")), F.col("root"), F.col("municipality")).alias("is_branch"),
    )


_AT = "coalesce(list_position(list_transform(segs, lambda s: regexp_matches(s, '{0}')), true), 0)"
_NOT_TRANSLATED = f"NOT (coalesce(regexp_matches(segs[1], '^[a-z]{{2}}(-[a-z]{{2}})?$'), false) AND NOT list_contains({_LIST(urls.OWN_LANGUAGES)}, segs[1]))"
_IN_PATH = "coalesce(" + ", ".join(_made_sql(*(f"regexp_extract(p, '{a}', {k})" for k in (1, 2, 3))) for a in days.ADDRESSES) + ")"
_ADDRESSES = f"""a0 AS (SELECT id, url, {_PATH.format("url")} AS p, {_SEGMENTS.format("url")} AS segs FROM items),
a1 AS (SELECT *, {_AT.format(urls.NEWS_PART)} AS news_at, {_AT.format(urls.CAREER_PART)} AS job_at, {_IN_PATH} AS day FROM a0),
a2 AS (SELECT *, coalesce(len(segs) >= 2 AND {_NOT_TRANSLATED} AND news_at > 0 AND news_at < len(segs) AND NOT (list_contains({_LIST(urls.NEWS_INDEX)}, segs[-1]) OR regexp_matches(segs[-1], '^[0-9]+$') OR list_has_any(segs, {_LIST(urls.NO_ARTICLE)})) AND length(segs[-1]) >= 8 AND (regexp_matches(segs[-1], '[-_]') OR day IS NOT NULL), false) AS is_article,
  coalesce(len(segs) >= 2 AND {_NOT_TRANSLATED} AND job_at > 0 AND job_at < len(segs) AND NOT (list_contains({_LIST(urls.CAREER_INDEX)}, segs[-1]) OR regexp_matches(segs[-1], '^[0-9]+$') OR list_has_any(segs, {_LIST(urls.NO_POSTING)})) AND length(segs[-1]) >= 4, false) AS is_posting,
  coalesce(len(segs) BETWEEN 1 AND 2 AND list_contains({_LIST(w for w in urls.CAREER_INDEX if w not in ("en", "no", "nb"))}, segs[-1]), false) AS is_careers_index,
  array_to_string(segs[1:CASE WHEN news_at > 0 THEN news_at ELSE len(segs) END], '/') AS section FROM a1)"""


@query(f"""WITH items AS (SELECT DISTINCT activity_id AS id, source_url AS url FROM activities UNION SELECT DISTINCT job_id, source_url FROM jobs UNION SELECT DISTINCT job_id, found_on_url FROM jobs UNION SELECT DISTINCT CAST(fetch_id AS VARCHAR), url FROM fetch_results), {_ADDRESSES}
SELECT id, url, is_article, is_posting, is_careers_index, section, day FROM a2 WHERE url IS NOT NULL""")
def address_classes(spark, folder):
    """Pages of sites, told apart by their addresses."""
    read = lambda table, key, url: load(spark, folder, table).select(F.col(key).cast("string").alias("id"), F.col(url).alias("url"))
    rows = read("activities", "activity_id", "source_url").union(read("jobs", "job_id", "source_url")).union(read("jobs", "job_id", "found_on_url")).union(read("fetch_results", "fetch_id", "url")).where("url is not null").distinct()
    u = F.col("url")
    return rows.select("id", "url", urls.is_article(u).alias("is_article"), urls.is_posting(u).alias("is_posting"), urls.is_careers_index(u).alias("is_careers_index"), urls.news_section(u).alias("section"), days.day_in_address(urls.path(u)).alias("day"))


#: In the test tables one portal stands for a platform.
_PORTAL = {"sosial.example": "x"}


@query(f"""WITH c AS (SELECT candidate_id, url, {_HOST.format("url")} AS host, list_filter(string_split({_PATH.format("url")}, '/'), lambda s: s <> '') AS parts FROM (SELECT DISTINCT candidate_id, url FROM candidates)),
k AS (SELECT * FROM c WHERE (host = 'sosial.example' OR host LIKE '%.sosial.example') AND len(parts) = 1 AND NOT list_contains({_LIST(urls.NO_PROFILE["x"])}, lower(parts[1])))
SELECT candidate_id, 'x' AS platform, 'https://sosial.example/' || parts[1] AS profile, CASE WHEN regexp_matches(lower(parts[1]), '^[0-9]+$|^uc[a-z0-9_-]{{20,}}$') THEN '' ELSE {_COMPACT.format("regexp_replace(lower(parts[1]), '^@+', '')")} END AS account FROM k""")
def social_accounts(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", "url").distinct().withColumn("s", urls.social_profile(F.col("url"), _PORTAL)).where("s is not null")
    return rows.select("candidate_id", "s.platform", F.col("s.url").alias("profile"), names.account(F.col("s.url")).alias("account"))


_BOARD_HOSTS = ("bedriftsportalen.example",)


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, url, {_HOST.format("url")} AS host, lower({_PATH.format("url")}) AS p FROM candidates)
SELECT candidate_id, regexp_replace(trim(url), '#.*$', '') AS board FROM c WHERE regexp_matches(lower(trim(url)), '^https?://') AND ((host = 'bedriftsportalen.example' AND regexp_matches(p, '[0-9]{{3,}}|/(arbeidsgiver|employers?|bedrift|company|companies|stilling|job)s?/')) OR host LIKE '%.bedriftsportalen.example') AND NOT regexp_matches(p, '\\.(js|css|png|jpe?g|svg|gif|webp|ico)$')""")
def job_boards(spark, folder):
    """Addresses of one employer's board; in the test tables a portal stands for a recruiting system."""
    rows = load(spark, folder, "candidates").select("candidate_id", "url").distinct()
    return rows.select("candidate_id", urls.job_board(F.col("url"), _BOARD_HOSTS).alias("board")).where("board is not null")


_PUBLISHED_SQL = "coalesce(" + ", ".join(_day_sql(f"regexp_extract(t, '(?i){p}', 1)") for p in days.PUBLICATION) + ")"
_DEADLINE_SQL = "coalesce(" + ", ".join(_day_sql(f"regexp_extract(t, '(?i){p}', 1)") for p in days.DEADLINES) + f", CASE WHEN regexp_matches(t, '(?i){days.NO_DEADLINE}') THEN 'snarest' END, " + _day_sql(f"regexp_extract(t, '(?i){days.WITHIN}', 1)") + ")"


@query(f"""WITH d AS (SELECT fetch_id, body AS t FROM (SELECT DISTINCT fetch_id, body FROM fetch_results WHERE body IS NOT NULL)) SELECT fetch_id, {_PUBLISHED_SQL} AS published, {_DEADLINE_SQL} AS deadline FROM d""")
def days_in_pages(spark, folder):
    rows = load(spark, folder, "fetch_results").where("body is not null").select("fetch_id", "body").distinct()
    return rows.select("fetch_id", days.day_in_text(F.col("body")).alias("published"), days.deadline_in_text(F.col("body")).alias("deadline"))


@query(f"""SELECT activity_id, {_day_sql("activity_date")} AS day FROM (SELECT DISTINCT activity_id, activity_date FROM activities) UNION ALL SELECT job_id, {_day_sql("deadline")} FROM (SELECT DISTINCT job_id, deadline FROM jobs)""")
def stated_days(spark, folder):
    rows = load(spark, folder, "activities").select("activity_id", F.col("activity_date").alias("t")).distinct().union(load(spark, folder, "jobs").select("job_id", "deadline").distinct())
    return rows.select("activity_id", days.day_of(F.col("t")).alias("day"))


_SIGNS = extract.POSTING_WORDS


@query(f"""WITH {_JOB} SELECT job_id, array_to_string(list_filter([CASE WHEN coalesce(deadline <> '', false) THEN 'deadline' END, CASE WHEN coalesce(regexp_matches(coalesce(job_title, '') || ' ' || coalesce(description, ''), '(?i){_SIGNS}'), false) THEN 'posting_terms' END,
  CASE WHEN coalesce(extraction_method = 'html', false) THEN 'card_element' END], lambda x: x IS NOT NULL), ',') AS signs FROM job""")
def posting_signs(spark, folder):
    rows = _first(spark, folder, "jobs", "job_id", "deadline", "job_title", "description", "source_url", "extraction_method")
    said = F.concat(F.coalesce("job_title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return rows.select("job_id", F.array_join(extract.posting_signs(F.col("source_url"), said, F.col("deadline"), F.col("extraction_method") == "html"), ",").alias("signs"))


# Extraction


def _page_rows(spark, folder):
    return load(spark, folder, "fetch_results").where("body is not null").groupBy("fetch_id").agg(F.min("url").alias("url"), F.min("body").alias("body"))


_BODY = "pg AS (SELECT fetch_id, min(url) AS base, min(body) AS body FROM fetch_results WHERE body IS NOT NULL GROUP BY 1)"
_ANCHOR_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"
_RESOLVED = r"""CASE WHEN l = '' OR regexp_matches(l, '^(?i)(#|javascript:|mailto:|tel:)') THEN NULL WHEN regexp_matches(l, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN 'https:' || l
  WHEN starts_with(l, '/') THEN regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || l
  WHEN regexp_matches(regexp_replace(regexp_replace(base, '[?#].*$', ''), '(://[^/]+.*/)[^/]*$', '\1'), '://[^/]+/') THEN regexp_replace(regexp_replace(base, '[?#].*$', ''), '(://[^/]+.*/)[^/]*$', '\1') || l
  ELSE regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || '/' || l END"""
_LINKS = f"""{_BODY}, an AS (SELECT fetch_id, base, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS place FROM (SELECT fetch_id, base, regexp_extract_all(regexp_replace(regexp_replace(body, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)(<a\\b[^>]*>.*?</a>)', 1) AS anchors FROM pg)),
lk0 AS (SELECT fetch_id, base, place, trim(regexp_extract(a, '(?i)href\\s*=\\s*["'']([^"'']*)', 1)) AS l, {_ANCHOR_TEXT.format("a")} AS text FROM an),
lk1 AS (SELECT fetch_id, base, place, text, {_RESOLVED} AS url FROM lk0),
lk2 AS (SELECT *, {_CANONICAL.format("url")} AS u FROM lk1),
lk AS (SELECT fetch_id, base, place, url, text, u FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id, u ORDER BY place) AS rn FROM lk2 WHERE u IS NOT NULL) WHERE rn = 1)"""


def _links(spark, folder):
    pages = _page_rows(spark, folder)
    return extract.page_links(pages, "fetch_id", "url", "body").join(pages.select("fetch_id", F.col("url").alias("base")), "fetch_id")


@query(f"WITH {_LINKS} SELECT fetch_id, CAST(place AS INT) AS place, url, text FROM lk")
def page_links(spark, folder):
    return extract.page_links(_page_rows(spark, folder), "fetch_id", "url", "body")


@query(f"WITH {_LINKS} SELECT fetch_id, CAST(place AS INT) AS place, url, text AS title FROM lk WHERE {_HOST.format('url')} = {_HOST.format('base')} AND length(trim(text)) >= 15 AND NOT list_contains({_LIST(extract.LINK_TEXTS)}, lower(trim(text)))")
def article_links(spark, folder):
    return extract.article_links(_links(spark, folder), "fetch_id", "url", "text", "base").select("fetch_id", "place", "url", F.col("text").alias("title"))


_KIND_SQL, _INPATH_SQL, _NUMBER_SQL, _QUOTA_SQL = ("CASE " + " ".join(
    f"WHEN regexp_matches(p, '{'|'.join(w.replace('-', '[-]') for w in words)}') OR regexp_matches(said, '{'|'.join(w.replace('-', ' ').replace('_', ' ') for w in words)}') THEN "
    + [f"'{name}'", f"(CASE WHEN regexp_matches(p, '{'|'.join(w.replace('-', '[-]') for w in words)}') THEN 0 ELSE 1 END)", str(k), str(share)][what]
    for k, (name, words, share) in enumerate(extract.PRIORITIES)) + " END" for what in range(4))


@query(f"""WITH {_LINKS}, q0 AS (SELECT fetch_id, u, lower({_PATH.format("url")}) AS p, lower(text) AS said, len({_SEGMENTS.format("url")}) AS d FROM lk WHERE {_HOST.format("url")} = {_HOST.format("base")} AND u <> {_CANONICAL.format("base")}),
q1 AS (SELECT *, {_KIND_SQL} AS kind, {_INPATH_SQL} AS ip, {_NUMBER_SQL} AS k, {_QUOTA_SQL} AS q, length(p) AS l FROM q0 WHERE NOT regexp_matches(p, '{extract.NO_PAGE}') AND NOT contains(p, 'nyhetsbrev') AND NOT contains(p, 'newsletter')),
q2 AS (SELECT *, row_number() OVER (PARTITION BY fetch_id, kind ORDER BY ip, d, l, u) AS rn FROM q1 WHERE kind IS NOT NULL),
q3 AS (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY CASE WHEN rn <= q THEN 0 ELSE 1 END, CASE WHEN rn <= q THEN rn ELSE 0 END, k, ip, d, l, u) AS place FROM q2)
SELECT fetch_id, u AS url, kind, CAST(place AS INT) AS place FROM q3 WHERE place <= 8""")
def priority_links(spark, folder):
    return extract.priority_links(_links(spark, folder), "fetch_id", "url", "text", "base")


@query(f"""WITH {_BODY}, b AS (SELECT fetch_id, base, coalesce(nullif(regexp_extract(body, '"datePublished"\\s*:\\s*"(20\\d{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))', 1), ''), nullif(replace(regexp_extract(base, '/(20\\d{{2}}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\\d|3[01]))(?:[/-]|$)', 1), '/', '-'), ''),
  CASE WHEN len(list_distinct(regexp_extract_all(body, '(20\\d{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))', 1))) = 1 THEN regexp_extract(body, '(20\\d{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))', 1) END) AS day FROM pg) SELECT fetch_id, day FROM b""")
def publication_days(spark, folder):
    return _page_rows(spark, folder).select("fetch_id", extract.publication_day(F.col("body"), F.col("url")).alias("day"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_WORDY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _documents_of(spark, folder, item, outer):
    """One text of each company, put together from its activities: a feed, a sitemap or a page with embedded data."""
    rows = _first(spark, folder, "activities", "activity_id", "company_orgnr", "title", "source_url", "activity_date", "activity_type").where("company_orgnr is not null and title is not null and source_url is not null")
    parts = rows.groupBy("company_orgnr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("activity_id", item.alias("x")))), lambda x: x["x"]), outer[2]).alias("x"))
    return parts.select("company_orgnr", F.concat(F.lit(outer[0]), "x", F.lit(outer[1])).alias("body"))


_OF_COMPANY = f"{_ACT}, oc AS (SELECT *, row_number() OVER (PARTITION BY company_orgnr ORDER BY activity_id) - 1 AS place FROM act WHERE company_orgnr IS NOT NULL AND title IS NOT NULL AND source_url IS NOT NULL)"


@query(f"WITH {_OF_COMPANY} SELECT company_orgnr, CAST(place AS INT) AS place, {_WORDY.format('title')} AS title, trim(source_url) AS link, coalesce({_WORDY.format('activity_date')}, '') AS published FROM oc")
def feed_items(spark, folder):
    """Items of feeds that are put together from the activities of each company."""
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>"), _escaped(F.col("source_url")), F.lit("</link><pubDate>"), _escaped(F.coalesce("activity_date", F.lit(""))), F.lit("</pubDate></item>"))
    feeds = _documents_of(spark, folder, item, ("<rss><channel><title>x</title>", "</channel></rss>", "\n"))
    return extract.feed(feeds, "company_orgnr", "body").na.fill("", ["published", "title"])


@query(f"WITH {_OF_COMPANY} SELECT company_orgnr, CAST(place AS INT) AS place, trim(source_url) AS loc, coalesce({_WORDY.format('activity_date')}, '') AS lastmod FROM oc")
def sitemap_entries(spark, folder):
    """Entries of sitemaps that are put together likewise."""
    item = F.concat(F.lit("<url><loc>"), _escaped(F.col("source_url")), F.lit("</loc><lastmod>"), _escaped(F.coalesce("activity_date", F.lit(""))), F.lit("</lastmod></url>"))
    maps = _documents_of(spark, folder, item, ('<?xml version="1.0"?><urlset xmlns="x">', "</urlset>", "\n"))
    return extract.sitemap(maps, "company_orgnr", "body").na.fill("", ["lastmod"])


@query(f"WITH {_OF_COMPANY} SELECT company_orgnr, CAST(place AS INT) AS place, 'NewsArticle' AS kind, title, {_day_sql('activity_date')} AS day, source_url AS url FROM oc")
def embedded_articles(spark, folder):
    """Articles in embedded data, nested in lists and graphs."""
    thing = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("activity_date").alias("datePublished"), F.struct(F.col("source_url").alias("@id")).alias("mainEntityOfPage")))
    item = F.concat(F.lit('{"@type": "ListItem", "item": [{"x": '), thing, F.lit("}]}"))
    pages = _documents_of(spark, folder, item, ('<html><script type="application/ld+json">{"@graph": [{"@type": ["ItemList"], "e": [', "]}]}</script><body></body></html>", ", "))
    return extract.articles(pages, "company_orgnr", "body")


@query(f"WITH {_JOB}, oj AS (SELECT *, row_number() OVER (PARTITION BY company_orgnr ORDER BY job_id) - 1 AS place FROM job WHERE company_orgnr IS NOT NULL AND job_title IS NOT NULL) SELECT company_orgnr, CAST(place AS INT) AS place, job_title AS title, location, employment_type, company_orgnr AS employer, published_at, deadline, source_url AS url FROM oj")
def embedded_postings(spark, folder):
    """Job postings in embedded data that is put together from the jobs of each company."""
    rows = _first(spark, folder, "jobs", "job_id", "company_orgnr", "job_title", "location", "employment_type", "published_at", "deadline", "source_url").where("company_orgnr is not null and job_title is not null")
    place = F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address"))
    thing = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), F.col("job_title").alias("title"), F.array(place).alias("jobLocation"), F.col("employment_type").alias("employmentType"), F.struct(F.col("company_orgnr").alias("name")).alias("hiringOrganization"), F.col("published_at").alias("datePosted"), F.col("deadline").alias("validThrough"), F.col("source_url").alias("url")))
    parts = rows.groupBy("company_orgnr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("job_id", thing.alias("x")))), lambda x: x["x"]), ", ").alias("x"))
    pages = parts.select("company_orgnr", F.concat(F.lit("<SCRIPT type='application/ld+json'>["), "x", F.lit("]</SCRIPT>")).alias("body"))
    return extract.postings(pages, "company_orgnr", "body")


@query(f"""WITH {_ACT}, items AS (SELECT company_orgnr || '|' || activity_id AS id, source_url || '-artikkel' AS url FROM act WHERE company_orgnr IS NOT NULL AND source_url IS NOT NULL), {_ADDRESSES},
e AS (SELECT string_split(id, '|')[1] AS k, string_split(id, '|')[2] AS activity_id, url, array_to_string(segs, '/') AS p, segs, section, is_article, day FROM a2),
d AS (SELECT e.*, coalesce(e.day, {_day_sql("act.activity_date")}, '') AS sd FROM e JOIN act USING (activity_id)),
par AS (SELECT DISTINCT k, array_to_string(segs[1:n], '/') AS a FROM (SELECT k, segs, unnest(range(1, len(segs))) AS n FROM d)),
lv AS (SELECT * FROM d WHERE is_article AND NOT EXISTS (SELECT 1 FROM par WHERE par.k = d.k AND par.a = d.p)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, segs[-1] ORDER BY sd DESC, url) AS rn0 FROM lv) WHERE rn0 = 1),
s AS (SELECT k, section, row_number() OVER (PARTITION BY k ORDER BY max(sd) DESC, section) AS sec FROM b GROUP BY 1, 2),
r AS (SELECT b.k, b.url, b.sd, sec, row_number() OVER (PARTITION BY b.k, b.section ORDER BY sd DESC, url) AS rn FROM b JOIN s ON s.k = b.k AND s.section = b.section)
SELECT k AS company_orgnr, url, sd AS day, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn, sec) AS place FROM r) WHERE place <= 8""")
def selected_articles(spark, folder):
    rows = _first(spark, folder, "activities", "activity_id", "company_orgnr", "source_url", "activity_date").where("company_orgnr is not null and source_url is not null")
    entries = rows.select("company_orgnr", F.concat("source_url", F.lit("-artikkel")).alias("url"), days.day_of(F.col("activity_date")).alias("day"))
    return extract.selected_articles(entries, "company_orgnr", "url", "day")


# Official answers


@query("""SELECT fetch_id, json_extract_string(body, '$.organisasjonsnummer') AS number, json_extract_string(body, '$.navn') AS name, TRY_CAST(json_extract_string(body, '$.antallAnsatte') AS INT) AS employees, json_extract_string(body, '$.hjemmeside') AS website
FROM (SELECT DISTINCT fetch_id, body FROM fetch_results) WHERE json_valid(body) AND json_extract_string(body, '$.organisasjonsnummer') IS NOT NULL""")
def live_entities(spark, folder):
    rows = load(spark, folder, "fetch_results").select("fetch_id", "body").distinct().where(extract.is_json(F.col("body")))
    return official.entities(rows, "fetch_id", "body").select("fetch_id", "number", "name", "employees", "website")


def _accounts(spark, folder):
    """Answers of the register of accounts, put together from the evidence on each company's accounts."""
    rows = _evidence(spark, folder, "organisation_number", "field", "value").where("field = 'financials' and state = 'available' and value is not null and organisation_number is not null")
    year, revenue = F.get_json_object("value", "$.year"), F.get_json_object("value", "$.revenue")
    income = F.struct(F.struct(F.struct(revenue.try_cast("bigint").alias("sumDriftsinntekter")).alias("driftsinntekter")).alias("driftsresultat"))
    thing = F.struct(F.col("evidence_id").alias("id"), F.lit("SELSKAP").alias("regnskapstype"), F.lit("NOK").alias("valuta"), F.struct(F.concat(year, F.lit("-12-31")).alias("tilDato")).alias("regnskapsperiode"), income.alias("resultatregnskapResultat"))
    return rows.groupBy("organisation_number").agg(F.to_json(F.array_sort(F.collect_list(thing))).alias("body"))


_ACCOUNTS = f"""{_EVIDENCE}, fa AS (SELECT organisation_number, evidence_id, json_extract_string(value, '$.year') AS y, TRY_CAST(json_extract_string(value, '$.revenue') AS BIGINT) AS revenue FROM ev WHERE field = 'financials' AND state = 'available' AND value IS NOT NULL AND organisation_number IS NOT NULL),
fr AS (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY coalesce(y || '-12-31', '') DESC, evidence_id) AS place FROM fa)"""


@query(f"WITH {_ACCOUNTS} SELECT organisation_number, CAST(place AS INT) AS place, CAST(evidence_id AS VARCHAR) AS record_id, TRY_CAST(y AS INT) AS year, revenue FROM fr WHERE place <= 3")
def newest_accounts(spark, folder):
    return official.accounts(_accounts(spark, folder), "organisation_number", "body").select("organisation_number", "place", "record_id", "year", F.col("revenue").cast("bigint").alias("revenue"))


@query("SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders GROUP BY 1, 2")
def account_years(spark, folder):
    """Years in a list of years, put together from the orders of each customer."""
    rows = load(spark, folder, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.year("o_orderdate")))).alias("body"))
    return official.account_years(rows, "o_custkey", "body")


def _role_answers(spark, folder):
    """Answers of the register of roles, put together from orders: a customer's orders of a priority are a group."""
    rows = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderstatus")
    role = F.struct(F.struct(F.col("o_orderstatus").alias("kode"), F.lit("rolle").alias("beskrivelse")).alias("type"), F.struct(F.struct(F.lit("Navn").alias("fornavn"), F.col("o_orderkey").cast("string").alias("etternavn")).alias("navn")).alias("person"))
    group = rows.groupBy("o_custkey", "o_orderpriority", "d").agg(F.array_sort(F.collect_list(role)).alias("roller"))
    thing = F.struct(F.struct(F.col("o_orderpriority").alias("kode"), F.col("o_orderpriority").alias("beskrivelse")).alias("type"), F.col("d").alias("sistEndret"), "roller")
    return group.groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(thing)).alias("rollegrupper"))).alias("body"))


@query("""SELECT o_custkey, 'Navn ' || o_orderkey AS name, o_orderstatus AS role_code, o_orderpriority AS group_code, strftime(o_orderdate, '%Y-%m-%d') AS last_changed, false AS inactive FROM orders""")
def role_rows(spark, folder):
    return official.roles(_role_answers(spark, folder), "o_custkey", "body").select("o_custkey", "name", "role_code", "group_code", "last_changed", "inactive")


@query("""WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority AS "group", strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') BETWEEN 0 AND 365)
SELECT o_custkey, "group", changed, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY changed DESC, "group") AS place FROM e) WHERE place <= 3""")
def recent_roles(spark, folder):
    rows = official.roles(_role_answers(spark, folder), "o_custkey", "body")
    return official.recent_roles(rows, "o_custkey", F.lit("1998-06-01").cast("date"), ("1-URGENT", "2-HIGH"))


@query("""SELECT DISTINCT o_custkey, o_orderpriority AS "group", strftime(o_orderdate, '%Y-%m-%d') AS changed FROM orders""")
def role_events(spark, folder):
    return official.role_events(official.roles(_role_answers(spark, folder), "o_custkey", "body"), "o_custkey")


def _location_answers(spark, folder):
    """Answers on sub-units, put together from the postings of each company: a place of work is a sub-unit."""
    rows = _first(spark, folder, "jobs", "job_id", "company_orgnr", "location", "source_url").where("company_orgnr is not null and location is not null")
    thing = F.struct(F.col("job_id").alias("organisasjonsnummer"), F.col("location").alias("navn"), urls.host(F.col("source_url")).alias("hjemmeside"), F.concat(F.lit("post@"), urls.host(F.col("source_url"))).alias("epostadresse"))
    return rows.groupBy("company_orgnr").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(thing)).alias("underenheter")).alias("_embedded"))).alias("body"))


_UNITS = f"{_JOB}, un AS (SELECT company_orgnr, job_id, location, {_HOST.format('source_url')} AS h, row_number() OVER (PARTITION BY company_orgnr ORDER BY job_id) AS place FROM job WHERE company_orgnr IS NOT NULL AND location IS NOT NULL)"


@query(f"WITH {_UNITS} SELECT company_orgnr, CAST(place AS INT) AS place, job_id AS location_number, location AS name, h AS website, 'post@' || h AS email FROM un")
def location_rows(spark, folder):
    return official.locations(_location_answers(spark, folder), "company_orgnr", "body").select("company_orgnr", "place", "location_number", "name", "website", "email")


# Candidates

_MAIL = "regexp_extract(email, '@([^@\\s>]+)$', 1)"


@query(f"""WITH {_REGISTRY}, n AS (SELECT organisation_number, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS clean, coalesce(nullif(trim(municipality), ''), 'Norge') AS town, regexp_replace(lower({_MAIL}), '^www\\.', '') AS mail FROM reg),
b AS (SELECT *, trim(regexp_replace(clean, ' (AS|ASA|ENK|DA|ANS|NUF|SA|BRL|ESEK)$', '')) AS bare FROM n WHERE clean <> ''),
x AS (SELECT organisation_number, unnest(['"' || clean || '"', '"' || clean || '" ' || regexp_replace(organisation_number, '[^0-9]', '', 'g'), '"' || bare || '" ' || town, '"' || clean || '" ' || town, CASE WHEN contains(mail, '.') AND NOT list_contains({_LIST(candidates.SHARED_MAIL)}, mail) THEN '"' || bare || '" ' || mail END]) AS phrase, unnest([1, 2, 3, 4, 5]) AS o FROM b),
f AS (SELECT organisation_number, phrase, min(o) AS o FROM x WHERE phrase IS NOT NULL GROUP BY 1, 2)
SELECT organisation_number, CAST(row_number() OVER (PARTITION BY organisation_number ORDER BY o) AS INT) AS place, phrase FROM f""")
def search_phrases(spark, folder):
    return candidates.search_phrases(_registry(spark, folder, "name", "municipality", "email"), "organisation_number", "name", "municipality", "email")


@query()
def company_candidates(spark, folder):
    """Where to look for each company's site; the order is tested on small frames."""
    return candidates.company_candidates(_registry(spark, folder, "name", "municipality", "email", "website"), "organisation_number", "name", "municipality", "email", "website")


@query(f"""WITH {_REGISTRY}, {_UNITS}, own AS (SELECT organisation_number AS k, 0 AS n, 0 AS o, CASE WHEN contains(m, '.') AND NOT list_contains({_LIST(candidates.SHARED_MAIL)}, m) THEN 'https://' || regexp_replace(m, '^www\\.', '') END AS url, 'registered mail' AS reason FROM (SELECT organisation_number, lower({_MAIL}) AS m FROM reg)),
u0 AS (SELECT company_orgnr AS k, place AS n, h, {_TOKENS.format("location")} AS w FROM un WHERE place <= 5),
u1 AS (SELECT k, n, unnest([1, 2, 3, 4]) AS o, unnest(['https://' || h, CASE WHEN contains(h, '.') THEN 'https://' || h END, CASE WHEN len(w) >= 2 THEN 'https://' || w[1] || w[2] || '.no' END, CASE WHEN len(w) >= 2 THEN 'https://' || w[1] || '-' || w[2] || '.no' END]) AS url, unnest(['sub-unit''s site', 'sub-unit''s mail', 'sub-unit''s name', 'sub-unit''s name']) AS reason FROM u0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, url ORDER BY n, o) AS rn FROM (SELECT * FROM own UNION ALL SELECT * FROM u1) WHERE url IS NOT NULL) WHERE rn = 1)
SELECT k AS organisation_number, url, reason, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, o, url) AS place FROM f) WHERE place <= 4""")
def relationship_candidates(spark, folder):
    units = official.locations(_location_answers(spark, folder), "company_orgnr", "body").withColumnRenamed("company_orgnr", "organisation_number")
    return candidates.relationship_candidates(_registry(spark, folder, "email"), units, "organisation_number", "email")


_TIERS = ("tier0_brreg_seed", "tier1_deterministic_domain", "tier2_email_domain")


@query(f"""WITH c AS (SELECT DISTINCT candidate_id, discovery_tier, {_HOST.format("url")} AS host FROM candidates), r AS (SELECT *, coalesce(nullif(coalesce(list_position({_LIST(_TIERS)}, discovery_tier), 0), 0), 4) AS p FROM c),
b AS (SELECT *, first_value(p) OVER w AS bp, first_value(coalesce(discovery_tier, '')) OVER w AS bn FROM r WINDOW w AS (PARTITION BY host ORDER BY p, coalesce(discovery_tier, '')))
SELECT candidate_id, discovery_tier, host FROM b WHERE p = bp AND coalesce(discovery_tier, '') = bn""")
def first_provider(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", "discovery_tier", urls.host(F.col("url")).alias("host")).distinct()
    return candidates.first_provider(rows, "host", "discovery_tier", _TIERS)


_PAIRS = f"""cand AS (SELECT DISTINCT candidate_id, url, identity_evidence['page_title'] AS title, identity_evidence['place'] AS place FROM candidates), comp AS (SELECT organisation_number, min(name) AS name, min(municipality) AS municipality FROM fresh_companies WHERE organisation_number IS NOT NULL AND name IS NOT NULL GROUP BY 1),
pairs AS (SELECT candidate_id, organisation_number, url, title, place, name, municipality FROM cand JOIN comp ON {_TOKENS.format("title")}[1] = {_TOKENS.format("name")}[1])"""


def _pairs(spark, folder):
    """Pages beside the companies whose name begins with the same word as their title."""
    said = F.col("identity_evidence")
    pages = load(spark, folder, "candidates").select("candidate_id", "url", said["page_title"].alias("title"), said["place"].alias("place")).distinct()
    companies = load(spark, folder, "fresh_companies").where("organisation_number is not null and name is not null").groupBy("organisation_number").agg(F.min("name").alias("name"), F.min("municipality").alias("municipality"))
    word = lambda c: F.get(text.tokens(F.col(c)), F.lit(0))
    return pages.withColumn("_w", word("title")).join(companies.withColumn("_v", word("name")), F.col("_w") == F.col("_v")).drop("_w", "_v")


_HOLDS = "(len({0}) > 0 AND len(list_filter({0}, lambda w: NOT list_contains({1}, w))) = 0)"


SQL_OF_RESULTS = (f"""WITH {_PAIRS}, t AS (SELECT *, {_HOST.format("url")} AS host, {_TOKENS.format("name")} AS w, {_TOKENS.format("coalesce(title, '')")} AS tw, {_TOKENS.format("coalesce(place, '')")} AS sw, {_TOKENS.format("coalesce(municipality, '')")} AS mw, {_TOKENS.format("coalesce(" + _HOST.format("url") + ", '')")} AS hw FROM pairs),
s AS (SELECT *, contains(regexp_replace(concat_ws(' ', title, place), '[^0-9]', '', 'g'), regexp_replace(organisation_number, '[^0-9]', '', 'g')) AS a, {_HOLDS.format("w", "tw")} AS b, {_HOLDS.format("w", "list_concat(list_concat(tw, sw), hw)")} AS c, len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(array_to_string(hw, ''), x))) = 0 AS d, {_HOLDS.format("mw", "sw")} AS e FROM t),
p AS (SELECT *, CASE WHEN host IS NULL THEN 0.0 ELSE round_even(least(1.0, CASE WHEN a THEN 0.75 ELSE 0.0 END + CASE WHEN b THEN 0.45 WHEN c THEN 0.25 ELSE 0.0 END + CASE WHEN d THEN 0.3 ELSE 0.0 END + CASE WHEN e THEN 0.1 ELSE 0.0 END), 2) END AS score FROM s)
SELECT candidate_id, organisation_number, CAST(score AS DOUBLE) AS score, CASE WHEN host IS NULL THEN 'rejected' WHEN score >= 0.75 AND d AND (a OR b OR len(w) >= 2) THEN 'accepted' WHEN score >= 0.6 THEN 'review' ELSE 'rejected' END AS status FROM p""")


@query(SQL_OF_RESULTS)
def result_scores(spark, folder):
    none = F.lit(None).cast("string")
    scored = candidates.result_score(F.col("name"), F.col("organisation_number"), F.col("municipality"), none, F.col("url"), F.col("title"), F.col("place"))
    return _pairs(spark, folder).withColumn("r", scored).select("candidate_id", "organisation_number", "r.score", "r.status")


@query(f"""WITH {_PAIRS}, t AS (SELECT *, {_HOST.format("url")} AS host, {_TOKENS.format("name")} AS w, {_TOKENS.format("coalesce(title, '')")} AS tw FROM pairs)
SELECT candidate_id, organisation_number, round_even(least(1.0, 0.45 * (len(list_intersect(w, tw)) / greatest(len(w), 1)) + CASE WHEN coalesce(contains({_COMPACT.format("host")}, coalesce(w[1], '?')), false) THEN 0.3 ELSE 0.0 END + CASE WHEN {_COMPACT.format("coalesce(municipality, '')")} <> '' AND {_COMPACT.format("coalesce(municipality, '')")} = {_COMPACT.format("coalesce(place, '')")} THEN 0.25 ELSE 0.0 END), 4) AS score FROM t""")
def name_scores(spark, folder):
    return _pairs(spark, folder).select("candidate_id", "organisation_number", candidates.name_score(F.col("name"), F.col("title"), F.col("url"), F.col("municipality"), F.col("place")).alias("score"))


# Identity of profiles


def _social(spark, folder):
    pairs = _pairs(spark, folder).join(load(spark, folder, "fresh_companies").groupBy("organisation_number").agg(F.min("legal_form").alias("legal_form")), "organisation_number")
    root = F.regexp_replace(F.coalesce(F.get(text.tokens(F.col("name")), F.lit(0)), F.lit("")), "[^a-z0-9]", "")
    return identity.assess_social(identity.with_social_features(pairs, "name", "legal_form", "url", root, F.lit(False)))


_BARE = "regexp_replace(acc, '^@+', '')"
_ACCOUNT = f"CASE WHEN acc IS NULL OR regexp_matches(acc, '^[0-9]+$|^uc[a-z0-9_-]{{20,}}$') THEN '' ELSE {_COMPACT.format(_BARE)} END"
_SOCIAL = f"""{_PAIRS}, form AS (SELECT organisation_number, min(legal_form) AS legal_form FROM fresh_companies GROUP BY 1),
s0 AS (SELECT pairs.*, form.legal_form, {_PATH.format("url")} AS path, {_SEGMENTS.format("url")} AS segs, {_TOKENS.format("name")} AS w FROM pairs JOIN form USING (organisation_number)),
s1 AS (SELECT *, CASE WHEN list_contains({_LIST(names.ACCOUNT_PREFIXES)}, segs[1]) THEN segs[2] ELSE segs[1] END AS acc, {_COMPACT.format("coalesce(path, '')")} AS flat, list_filter(regexp_extract_all({_FOLD.format("coalesce(path, '')")}, '([a-z0-9]+)', 1), lambda x: length(x) > 1) AS parts, regexp_replace(coalesce(w[1], ''), '[^a-z0-9]', '', 'g') AS root FROM s0),
s2 AS (SELECT *, {_ACCOUNT} AS handle, list_filter(w, lambda x: contains(flat, x)) AS said FROM s1),
s3 AS (SELECT *, CASE WHEN list_contains({_LIST(names.PLATFORM_ACCOUNTS)}, handle) THEN 0.1 WHEN len(list_filter(parts[2:], lambda x: list_contains(['as', 'asa', 'da', 'ans', 'sa', 'nuf', 'ab', 'enk', 'ks', 'iks'], x) AND x <> lower(coalesce(legal_form, '')))) > 0 THEN 0.3
  WHEN len(said) > 0 AND len(list_filter(said, lambda x: NOT list_contains({_LIST(identity.GENERIC_WORDS)}, x))) = 0 THEN 0.3 WHEN len(w) > 0 AND contains(flat, array_to_string(w, '')) THEN 0.98 WHEN len(w) = 1 AND len(said) = 1 THEN 0.95 WHEN len(said) >= 2 AND len(said) >= 0.75 * len(w) THEN 0.9
  WHEN root <> '' AND handle <> '' AND NOT list_contains({_LIST(names.PLATFORM_ACCOUNTS)}, handle) AND ((starts_with(handle, root) AND list_contains({_LIST(names.AFTER_NAME)}, handle[length(root) + 1:])) OR (length(root) >= 6 AND contains(handle, root) AND length(handle) - length(root) <= 12)) THEN 0.92 ELSE 0.3 END AS score FROM s2)"""


@query(f"WITH {_SOCIAL} SELECT candidate_id, organisation_number, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'exact' WHEN score >= 0.8 THEN 'review' ELSE 'uncertain' END AS status FROM s3")
def social_identity(spark, folder):
    return _social(spark, folder).select("candidate_id", "organisation_number", "score", "status")


@query(f"""WITH {_SOCIAL}, {_ACT}, pg AS (SELECT company_orgnr AS organisation_number, bool_or(coalesce(identity_assessment.status = 'exact', false)) AS publishable FROM act WHERE company_orgnr IS NOT NULL GROUP BY 1), pr AS (SELECT organisation_number, count(*) FILTER (score >= 0.9) AS e, count(*) AS n FROM s3 GROUP BY 1)
SELECT organisation_number, publishable, CASE WHEN publishable THEN coalesce(e, 0) ELSE 0 END AS kept, coalesce(n, 0) - CASE WHEN publishable THEN coalesce(e, 0) ELSE 0 END AS quarantined FROM pg LEFT JOIN pr USING (organisation_number)""")
def gated_profiles(spark, folder):
    pages = _first(spark, folder, "activities", "activity_id", "company_orgnr", "identity_assessment").where("company_orgnr is not null")
    pages = pages.select(F.col("company_orgnr").alias("organisation_number"), F.coalesce("identity_assessment.status", F.lit("")).alias("status"))
    return identity.gated(pages, _social(spark, folder), "organisation_number")
