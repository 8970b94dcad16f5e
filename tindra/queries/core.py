"""Queries of the core operators over the test tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.functions import text, urls
from tindra.functions.hashing import content_hash, sequence_hash, set_hash
from tindra.operators import aggregates, candidates, evidence, extract, history, lookup, ranking, sampling, snapshots, synthesis
from tindra.plans import screen
from tindra.tables import load

AS_OF = "2026-10-04"


def _registry(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of each company, one row each: of redeliveries the last to arrive (their texts agree)."""
    version = F.struct("delivered_at", F.coalesce("employees", F.lit(-1))) if columns else F.lit(0)
    return evidence.latest_of_key(load(spark, folder, "registry"), ["organisation_number"], version, list(columns))


_REGISTRY = """reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number
  ORDER BY delivered_at DESC, coalesce(employees, -1) DESC, coalesce(name, '') DESC) AS rn FROM registry) WHERE rn = 1)"""


def _evidence(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of each evidence id, one row each, of redeliveries the last to arrive, with its published state."""
    version = F.struct("ingested_at", F.coalesce("status", F.lit("")))
    one = evidence.latest_of_key(load(spark, folder, "evidence"), ["evidence_id"], version, ["status", *columns])
    return one.withColumn("state", evidence.state(F.col("status")))


_STATE = """CASE WHEN status IN ('available', 'not_available', 'blocked', 'not_applicable', 'ambiguous', 'failed') THEN status
  WHEN status = 'not_found' THEN 'not_available' WHEN status = 'complete' THEN 'available'
  WHEN status IN ('blocked_policy', 'blocked_robots') THEN 'blocked' ELSE 'failed' END"""
_EVIDENCE = f"""ev AS (SELECT *, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id
  ORDER BY ingested_at DESC, coalesce(status, '') DESC) AS rn FROM evidence) WHERE rn = 1)"""
_HOST = r"regexp_replace(nullif(regexp_extract(lower(trim({0})), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#:@]+)', 1), ''), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', ''), '^[^/]*(/.*)$', 1), '/+$', '')"
_CANONICAL = "('https://' || " + _HOST + " || " + _PATH + ")"
_FOLD = "translate(replace(lower({0}), 'æ', 'ae'), 'åøäöüéèêëáàâãíìîïóòôõúùûñçčšžðđł', 'aoaoueeeeaaaaiiiioooouuuncczddl')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Samples


@query(f"WITH {_REGISTRY} SELECT organisation_number, sha256('s1:' || organisation_number) AS rank_hash FROM reg ORDER BY 2, 1 LIMIT 50")
def hash_rank_sample(spark, folder):
    return sampling.bottom_k(_registry(spark, folder), "organisation_number", 50, "s1")


@query(f"""WITH {_REGISTRY},
kept AS (SELECT organisation_number, true AS is_preserved, '' AS h FROM reg SEMI JOIN (SELECT DISTINCT organisation_number FROM fresh_companies) USING (organisation_number)
  ORDER BY sha256('s2:preserved:' || organisation_number), organisation_number LIMIT 60),
more AS (SELECT organisation_number, false AS is_preserved, sha256('s2:' || organisation_number) AS h FROM reg ANTI JOIN (SELECT DISTINCT organisation_number FROM fresh_companies) USING (organisation_number)
  ORDER BY h, organisation_number LIMIT 60),
taken AS (SELECT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM more) ORDER BY is_preserved DESC, h, organisation_number LIMIT 60),
placed AS (SELECT organisation_number, is_preserved, row_number() OVER (ORDER BY sha256('s2:order:' || organisation_number), organisation_number) AS position FROM taken)
SELECT *, CASE WHEN position <= round_even((SELECT count(*) FROM placed) * 0.6, 0) THEN 'train'
  WHEN position <= round_even((SELECT count(*) FROM placed) * 0.6, 0) + round_even((SELECT count(*) FROM placed) * 0.2, 0) THEN 'validation' ELSE 'test' END AS split FROM placed""")  # fmt: skip
def preserved_sample_split(spark, folder):
    taken = sampling.preserve_then_fill(_registry(spark, folder), "organisation_number", load(spark, folder, "fresh_companies"), 60, "s2")
    return sampling.split_by_position(taken, "position")


_BAND = "CASE WHEN employees IS NULL THEN 'unknown' WHEN employees = 0 THEN '0' WHEN employees < 5 THEN '1-4' WHEN employees < 20 THEN '5-19' WHEN employees < 100 THEN '20-99' ELSE '100+' END"
_STRATUM = f"coalesce(legal_form, 'none') || '|' || {_BAND} || '|' || CASE WHEN coalesce(website, '') <> '' THEN 'web' ELSE 'no web' END"


def _stratum():
    return sampling.stratum(F.col("legal_form"), sampling.size_band(F.col("employees")), F.when(F.coalesce(F.col("website"), F.lit("")) != "", "web").otherwise("no web"))


@query(f"WITH {_REGISTRY} SELECT {_STRATUM} AS stratum, count(*) AS n FROM reg GROUP BY 1")
def stratum_counts(spark, folder):
    return _registry(spark, folder, "legal_form", "employees", "website").groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("n"))


@query(f"""WITH {_REGISTRY} SELECT organisation_number, stratum, CAST(place AS INT) AS place FROM (SELECT organisation_number, {_STRATUM} AS stratum,
  row_number() OVER (PARTITION BY {_STRATUM} ORDER BY sha256('s3:' || organisation_number), organisation_number) AS place FROM reg) WHERE place <= 3""")
def stratified_sample(spark, folder):
    rows = _registry(spark, folder, "legal_form", "employees", "website")
    return sampling.per_stratum(rows, "organisation_number", _stratum(), 3, "s3").select("organisation_number", "stratum", "place")


@query(f"""WITH c AS (SELECT candidate_id, {_HOST.format("url")} AS host FROM candidates),
m AS (SELECT host, min(struct_pack(rank_hash := sha256('s4:' || candidate_id), candidate_id := candidate_id)) AS m FROM c WHERE host IS NOT NULL GROUP BY host)
SELECT host, m.candidate_id AS candidate_id, m.rank_hash AS rank_hash FROM m ORDER BY rank_hash, candidate_id LIMIT 40""")
def one_per_host(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", urls.host(F.col("url")).alias("host"))
    return sampling.one_per_group(rows, "candidate_id", "host", 40, "s4")


@query(f"""WITH {_REGISTRY}, n AS (SELECT organisation_number, row_number() OVER (ORDER BY organisation_number) - 1 AS position FROM reg),
s AS (SELECT greatest(count(*) // 25, 1) AS step FROM reg) SELECT organisation_number, position FROM n, s WHERE position % step = 0 AND position < step * 25""")
def step_sample(spark, folder):
    return sampling.every_step(_registry(spark, folder), [F.col("organisation_number")], 25)


@query(f"""WITH {_REGISTRY} SELECT CASE WHEN employees >= 10 AND coalesce(website, '') <> '' THEN 'larger with site' WHEN employees >= 10 THEN 'larger without site'
  WHEN coalesce(website, '') <> '' THEN 'smaller with site' ELSE 'smaller without site' END AS cohort, count(*) AS n, min(organisation_number) AS first FROM reg GROUP BY 1""")
def cohorts(spark, folder):
    large, site = F.coalesce(F.col("employees") >= 10, F.lit(False)), F.coalesce(F.col("website"), F.lit("")) != ""
    cohort = F.when(large & site, "larger with site").when(large, "larger without site").when(site, "smaller with site").otherwise("smaller without site")
    return _registry(spark, folder, "employees", "website").groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"), F.min("organisation_number").alias("first"))


# Lookups

_REQUESTED = "req AS (SELECT organisation_number, row_number() OVER (ORDER BY organisation_number) AS ordinal FROM (SELECT DISTINCT organisation_number FROM fresh_companies))"


def _requested(spark, folder):
    keys = load(spark, folder, "fresh_companies").select("organisation_number").distinct()
    return sampling.numbered(keys, [F.col("organisation_number")]).select("organisation_number", (F.col("position") + 1).alias("ordinal"))


@query(f"""WITH {_REGISTRY}, {_REQUESTED}, a AS (SELECT organisation_number, name FROM reg WHERE coalesce(website, '') <> ''), f AS (SELECT organisation_number, min(name) AS name FROM fresh_companies GROUP BY 1)
SELECT req.organisation_number, req.ordinal, CASE WHEN a.organisation_number IS NOT NULL THEN a.name ELSE f.name END AS name, CASE WHEN a.organisation_number IS NOT NULL THEN 'registry' WHEN f.organisation_number IS NOT NULL THEN 'fresh' END AS source
FROM req LEFT JOIN a USING (organisation_number) LEFT JOIN f ON f.organisation_number = req.organisation_number""")
def lookup_with_fallback(spark, folder):
    primary = _registry(spark, folder, "name", "website").where("coalesce(website, '') <> ''")
    return lookup.with_fallback(_requested(spark, folder), [("registry", primary), ("fresh", load(spark, folder, "fresh_companies"))], "organisation_number", ["name"])


@query(f"WITH {_REGISTRY}, {_REQUESTED} SELECT req.* FROM req ANTI JOIN (SELECT organisation_number FROM reg WHERE coalesce(website, '') <> '') USING (organisation_number)")
def lookup_missing(spark, folder):
    return lookup.missing(_requested(spark, folder), _registry(spark, folder, "website").where("coalesce(website, '') <> ''"), "organisation_number")


@query(f"WITH {_REGISTRY}, {_REQUESTED} SELECT req.organisation_number, req.ordinal, reg.name IS NOT NULL OR reg.legal_form IS NOT NULL AS found, reg.name, reg.legal_form FROM req LEFT JOIN reg USING (organisation_number)")
def ordered_lookup(spark, folder):
    return lookup.lookup(_requested(spark, folder), _registry(spark, folder, "name", "legal_form"), "organisation_number", "ordinal")


@query("SELECT organisation_number, count(*) AS n FROM registry GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    return lookup.repeated(load(spark, folder, "registry"), "organisation_number")


# States and evidence


@query(f"WITH {_EVIDENCE} SELECT field, count(*) FILTER (state = 'available') AS available, count(*) FILTER (state = 'not_available') AS not_available, count(*) FILTER (state = 'blocked') AS blocked, count(*) FILTER (state = 'not_applicable') AS not_applicable, count(*) FILTER (state = 'ambiguous') AS ambiguous, count(*) FILTER (state = 'failed') AS failed FROM ev GROUP BY field")
def state_by_module(spark, folder):
    return aggregates.state_table(_evidence(spark, folder, "field"), "field", "state", evidence.STATES)


@query("""SELECT status, CASE WHEN status = 200 THEN 'available' WHEN status IN (404, 410) THEN 'not_available' WHEN status IN (401, 403, 429, 451) THEN 'blocked' ELSE 'failed' END AS state, count(*) AS n FROM fetch_results GROUP BY 1, 2""")
def fetch_states(spark, folder):
    return load(spark, folder, "fetch_results").groupBy("status", evidence.state_of_fetch(F.col("status")).alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {_EVIDENCE} SELECT count(*) AS rows, count(DISTINCT evidence_id) AS keys, count(*) FILTER (evidence_id IS NULL) AS without_key, 0 AS unknown_states, count(*) = count(DISTINCT evidence_id) AS valid FROM ev")
def evidence_validation(spark, folder):
    return aggregates.validate(_evidence(spark, folder), "evidence_id", "state", evidence.STATES)


@query("""SELECT violated, count(*) AS n FROM (SELECT array_to_string(list_filter([
  CASE WHEN NOT coalesce(regexp_matches(source_url, '^https?://[^/ ]+\\.[^/ ]+'), false) THEN 'source_url' END,
  CASE WHEN NOT coalesce(trim(retrieved_at) <> '', false) THEN 'retrieved_at' END,
  CASE WHEN NOT coalesce(regexp_matches(content_sha256, '^[0-9a-f]{64}$'), false) THEN 'content_hash' END], lambda x: x IS NOT NULL), ',') AS violated FROM evidence) GROUP BY 1""")
def provenance_violations(spark, folder):
    broken = F.array_join(evidence.violations(evidence.provenance_rules()), ",")
    return load(spark, folder, "evidence").groupBy(broken.alias("violated")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetch_id, content_sha256) AS turn FROM fetch_results)
SELECT sha256(body) AS sha256, 'page' AS kind, any_value(length(body)) AS characters,
  sha256(body) NOT IN (SELECT sha256(body) FROM n WHERE body IS NOT NULL AND turn = 1) AS is_new FROM n WHERE body IS NOT NULL GROUP BY 1""")
def content_store(spark, folder):
    """All bodies; new are those that no first fetch of an address brought."""
    pages = load(spark, folder, "fetch_results").select("fetch_id", "url", "content_sha256", "body").withColumn("kind", F.lit("page"))
    first = ranking.newest(pages, "url", 1, [F.col("fetch_id"), F.col("content_sha256")])
    seen = evidence.store_bodies(first, "body", "kind")
    return evidence.store_bodies(pages, "body", "kind", seen).select("sha256", "kind", F.length("body").cast("bigint").alias("characters"), "is_new")


@query(f"""WITH p AS (SELECT {_CANONICAL.format("url")} AS u, min(content_sha256) AS ref FROM fetch_results WHERE content_sha256 IS NOT NULL AND url IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT activity_id, source_url, found_on_url FROM activities)
SELECT activity_id, coalesce(p1.ref, p2.ref) AS page_sha FROM a LEFT JOIN p p1 ON p1.u = {_CANONICAL.format("source_url")} LEFT JOIN p p2 ON p2.u = {_CANONICAL.format("found_on_url")}""")
def attached_pages(spark, folder):
    items = load(spark, folder, "activities").select("activity_id", "source_url", "found_on_url").distinct()
    pages = load(spark, folder, "fetch_results").select(F.col("url").alias("page_url"), F.col("content_sha256").alias("page_sha"))
    return evidence.attach_references(items, pages, ["source_url", "found_on_url"], "page_url", "page_sha").select("activity_id", "page_sha")


@query(f"""WITH {_EVIDENCE}, k AS (SELECT organisation_number, field, max(struct_pack(t := ingested_at, s := state, i := evidence_id)) AS now, max(struct_pack(t := ingested_at, s := state, i := evidence_id)) FILTER (state = 'available') AS good FROM ev GROUP BY 1, 2)
SELECT organisation_number, field, CASE WHEN now.s = 'failed' AND good IS NOT NULL THEN good.s ELSE now.s END AS state, CASE WHEN now.s = 'failed' AND good IS NOT NULL THEN good.i ELSE now.i END AS evidence_id, now.s = 'failed' AND good IS NOT NULL AS carried_forward FROM k""")
def carried_forward(spark, folder):
    key, version = ["organisation_number", "field"], F.struct("ingested_at", "state", "evidence_id")
    rows = _evidence(spark, folder, *key, "ingested_at").select(*key, "state", "evidence_id", "ingested_at")
    current = evidence.latest_of_key(rows, key, version).drop("ingested_at")
    previous = evidence.latest_of_key(rows.where("state = 'available'"), key, version).drop("ingested_at")
    return evidence.carry_forward(current, previous, key)


# Addresses and names


@query(f"""SELECT candidate_id, {_HOST.format("url")} AS host, {_CANONICAL.format("url")} AS canonical,
  CASE WHEN {_HOST.format("url")} IS NULL THEN NULL WHEN list_has_any(string_split(lower({_PATH.format("url")}), '/'), ['karriere', 'jobb', 'jobs', 'careers', 'stilling', 'stillinger', 'ledige-stillinger', 'vacancies']) THEN 'careers'
  WHEN list_has_any(string_split(lower({_PATH.format("url")}), '/'), ['nyheter', 'aktuelt', 'news', 'presse', 'artikkel', 'blogg', 'blog']) THEN 'news' ELSE 'website' END AS kind FROM (SELECT DISTINCT candidate_id, url FROM candidates)""")
def url_facts(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", "url").distinct()
    return rows.select("candidate_id", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canonical"), urls.source_type(F.col("url")).alias("kind"))


_WORDS = "list_filter(regexp_extract_all(" + _FOLD + ", '([a-z0-9]+)', 1), lambda x: length(x) > 1 AND x NOT IN ('as', 'asa', 'ans', 'da', 'enk', 'iks', 'sa', 'sam', 'sti', 'stiftelsen', 'nuf', 'ab', 'b', 'v', 'limited', 'ltd', 'inc', 'plc', 'the', 'og', 'and'))"


@query(f"""WITH {_REGISTRY} SELECT organisation_number, array_to_string({_WORDS.format("coalesce(name, '')")}, ' ') AS words, regexp_replace({_FOLD.format("coalesce(name, '')")}, '[^a-z0-9]', '', 'g') AS compact FROM reg""")
def name_words(spark, folder):
    return _registry(spark, folder, "name").select("organisation_number", F.array_join(text.tokens(F.col("name")), " ").alias("words"), text.compact(F.col("name")).alias("compact"))


@query("""SELECT activity_id, nullif(substring(trim(regexp_replace(regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '( - les mer| » kontakt oss)$', '', 'i'), ' [|»] [^|»]*$', '')), 1, 300), '') AS title FROM (SELECT DISTINCT activity_id, title FROM activities)""")
def clean_titles(spark, folder):
    rows = load(spark, folder, "activities").select("activity_id", "title").distinct()
    return rows.select("activity_id", text.clean_title(F.col("title")).alias("title"))


# First, newest, turn-taking


@query("""SELECT job_id, company_orgnr, source_url FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ingested_at DESC, source_url) AS rn FROM jobs WHERE job_id <> '') WHERE rn = 1""")
def jobs_kept_first(spark, folder):
    return ranking.keep_first(load(spark, folder, "jobs"), ["job_id"], [F.desc("ingested_at"), F.col("source_url")]).select("job_id", "company_orgnr", "source_url")


@query("""SELECT id, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, origin) AS rn FROM (SELECT organisation_number AS id, 'fresh' AS origin, 0 AS o FROM fresh_companies UNION ALL SELECT organisation_number, 'registry', 1 FROM registry) WHERE id <> '') WHERE rn = 1""")
def union_kept_first(spark, folder):
    frames = [load(spark, folder, t).select(F.col("organisation_number").alias("id"), F.lit(n).alias("origin")) for t, n in (("fresh_companies", "fresh"), ("registry", "registry"))]
    return ranking.keep_first_of_union(frames, ["id"], [F.col("origin")])


@query("SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 8")
def newest_events(spark, folder):
    return ranking.newest(load(spark, folder, "events").select("user_id", "event_id", "ts"), "user_id", 8, [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id", "place")


@query("""SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events) WHERE NOT (n >= 3 AND value < 20)""")
def without_bursts(spark, folder):
    rows = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return ranking.without_bursts(rows, ["user_id", "day"], F.col("value") < 20).select("event_id")


@query("""WITH t AS (SELECT user_id, event_type, max(ts) AS top FROM events GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY top DESC, event_type) AS sec FROM t),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT i.user_id, event_id, row_number() OVER (PARTITION BY i.user_id ORDER BY rn, sec) AS place FROM i JOIN s USING (user_id, event_type)) WHERE place <= 6""")
def round_robin_events(spark, folder):
    rows = load(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.round_robin(rows, "user_id", "event_type", [F.desc("ts"), F.col("event_id")], "ts", 6).select("user_id", "event_id", "place")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN rn <= 1 THEN 0 ELSE 1 END, CASE WHEN rn <= 1 THEN rn ELSE 0 END, l_extendedprice DESC, l_linenumber) AS place FROM i) WHERE place <= 3""")
def quota_pick(spark, folder):
    rows = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return ranking.quota_then_rest(rows, "l_orderkey", "l_returnflag", [F.desc("l_extendedprice"), F.col("l_linenumber")], 1, 3).select("l_orderkey", "l_linenumber", "place")


@query()
def activities_by_either_key(spark, folder):
    """Of each company the activities of which neither address nor title and day was seen before; a fold, so there is no SQL."""
    rows = load(spark, folder, "activities").select("company_orgnr", "activity_id", urls.canonical(F.col("source_url")).alias("address"), F.concat_ws("|", "title", "activity_date").alias("said")).distinct()
    return ranking.either_key(rows, "company_orgnr", "address", "said", ["activity_id"]).select("company_orgnr", "activity_id")


# Aggregates


@query(f"""SELECT company_orgnr, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, coalesce(array_to_string(list_sort(list_distinct(list(activity_type) FILTER (ok))), ','), '') AS platforms,
  count(DISTINCT source_url) FILTER (ok) AS distinct_urls, count(*) FILTER (ok AND epoch(TIMESTAMP '{AS_OF} 00:00:00') - floor(epoch(ingested_at)) BETWEEN 0 AND 45 * 86400) AS fresh
FROM (SELECT *, coalesce(identity_assessment.score >= 0.9, false) AS ok FROM (SELECT DISTINCT ON (activity_id) * FROM activities ORDER BY activity_id, ingested_at)) GROUP BY 1""")
def activity_footprint(spark, folder):
    rows = ranking.keep_first(load(spark, folder, "activities"), ["activity_id"], [F.col("ingested_at")])
    return aggregates.footprint(rows, "company_orgnr", "activity_type", "source_url", F.col("identity_assessment.score") >= 0.9, F.col("ingested_at").cast("timestamp"), F.lit(f"{AS_OF} 00:00:00").cast("timestamp"))


@query("""SELECT user_id, items, authors, CASE WHEN items >= 10 AND authors >= 2 THEN round_even(50 + 50 * m, 1) END AS score FROM (SELECT user_id, count(event_type) AS items, count(DISTINCT CAST(ts AS DATE)) AS authors, avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 WHEN 'error' THEN -1 END) AS m FROM events GROUP BY 1)""")
def gated_score(spark, folder):
    rows = load(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return aggregates.gated_score(rows, "user_id", "event_type", {"purchase": 1, "view": 0, "error": -1}, "day")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS item, source FROM documents WHERE text IS NOT NULL), s AS (SELECT item FROM d GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source FROM d ANTI JOIN s USING (item)""")
def shared_withheld(spark, folder):
    rows = load(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("item"), "source")
    return aggregates.withhold_shared(rows, "item", "source").select("doc_id", "source")


@query("""SELECT sha256(text) AS item, count(DISTINCT organisation_number) AS owners FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT organisation_number) > 1""")
def item_owners(spark, folder):
    return aggregates.owners(load(spark, folder, "documents").withColumn("item", F.sha2("text", 256)), "item", "organisation_number").where("owners > 1")


@query("""SELECT event_type, n, list_sort(v)[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50, list_sort(v)[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95 FROM (SELECT event_type, count(value) AS n, list(value) FILTER (value IS NOT NULL) AS v FROM events GROUP BY 1)""")
def order_statistics(spark, folder):
    return aggregates.order_statistics(load(spark, folder, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH j AS (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, ingested_at), b AS (SELECT coalesce(extraction_method, 'none') AS method, coalesce(identity_assessment.score >= 0.9, false) AS f, coalesce(len(posting_evidence) > 0, false) AS t FROM j),
s AS (SELECT method, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn FROM b GROUP BY 1)
SELECT method, tp AS true_positive, fp AS false_positive, fn AS false_negative, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM s""")
def rates_by_method(spark, folder):
    rows = ranking.keep_first(load(spark, folder, "jobs"), ["job_id"], [F.col("ingested_at")]).withColumn("method", F.coalesce("extraction_method", F.lit("none")))
    return aggregates.rates(rows, "method", F.col("identity_assessment.score") >= 0.9, F.size("posting_evidence") > 0)


# Comparisons in time


@query("""WITH a AS (SELECT organisation_number, min_by(employees, delivered_at) AS o, max_by(employees, delivered_at) AS n FROM (SELECT organisation_number, coalesce(CAST(employees AS VARCHAR), '?') AS employees, delivered_at FROM (SELECT DISTINCT organisation_number, employees, delivered_at FROM registry)) GROUP BY 1)
SELECT organisation_number, 'employees' AS field, o AS old_value, n AS new_value FROM a WHERE o <> n""")
def head_count_changes(spark, folder):
    rows = load(spark, folder, "registry").select("organisation_number", F.coalesce(F.col("employees").cast("string"), F.lit("?")).alias("employees"), "delivered_at").distinct()
    first = rows.groupBy("organisation_number").agg(F.min_by("employees", "delivered_at").alias("employees"))
    last = rows.groupBy("organisation_number").agg(F.max_by("employees", "delivered_at").alias("employees"))
    return history.field_changes(first, last, "organisation_number", ["employees"])


def _sides(spark, folder, *columns):
    """Each company's last row of each delivery as the previous and as the current side of a pair; ``delivery_no`` is that of the pair's later delivery."""
    rows = load(spark, folder, "snapshots").select("delivery_no", "organisation_number", F.struct("captured_at", "snapshot_id").alias("at"), *columns)
    last = evidence.latest_of_key(rows, ["delivery_no", "organisation_number"], F.col("at")).withColumnRenamed("delivery_no", "_d")
    tagged = last.join(F.broadcast(snapshots.consecutive(rows, "delivery_no")), "_d").withColumnRenamed("_pair", "delivery_no")  # twice as many rows as there are deliveries
    return tuple(tagged.where(F.col("_now") == now).select("delivery_no", "organisation_number", *columns) for now in (False, True))


_PAIRS_OF_DELIVERIES = "w AS (SELECT delivery_no AS d, lag(delivery_no) OVER (ORDER BY delivery_no) AS before FROM (SELECT DISTINCT delivery_no FROM snapshots WHERE delivery_no IS NOT NULL))"


@query(f"""WITH {_PAIRS_OF_DELIVERIES}, a AS (SELECT d AS delivery_no, organisation_number FROM snapshots JOIN w ON delivery_no = before), b AS (SELECT delivery_no, organisation_number FROM snapshots JOIN w ON delivery_no = d WHERE before IS NOT NULL)
SELECT *, 'previous' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'current' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def unmatched_companies(spark, folder):
    """Over every pair of consecutive deliveries."""
    return history.unmatched_keys(*_sides(spark, folder), "delivery_no", "organisation_number")


@query(f"""WITH {_PAIRS_OF_DELIVERIES}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_no, organisation_number ORDER BY captured_at DESC NULLS LAST, snapshot_id DESC NULLS LAST) AS rn FROM snapshots) WHERE rn = 1),
j AS (SELECT DISTINCT delivery_no, organisation_number, j.job_id AS job_id, j.source_url AS source_url FROM (SELECT delivery_no, organisation_number, unnest(jobs) AS j FROM s) WHERE j.job_id IS NOT NULL),
gone AS (SELECT w.d AS delivery_no, j.organisation_number, j.job_id, j.source_url FROM j JOIN w ON j.delivery_no = w.before WHERE NOT EXISTS (SELECT 1 FROM j AS k WHERE k.delivery_no = w.d AND k.organisation_number = j.organisation_number AND k.job_id = j.job_id)),
u AS (SELECT delivery_no, organisation_number, unnest(sources).url AS url FROM s)
SELECT delivery_no, organisation_number, job_id, CASE WHEN source_url IS NULL OR EXISTS (SELECT 1 FROM u WHERE u.delivery_no = gone.delivery_no AND u.organisation_number = gone.organisation_number AND contains(gone.source_url, u.url)) THEN 'REMOVED' ELSE 'OBSERVATION_GAP' END AS change_type FROM gone""")
def gone_jobs(spark, folder):
    """Over every pair of consecutive deliveries."""
    before, after = _sides(spark, folder, "jobs", "sources")
    items = lambda side: side.select("delivery_no", "organisation_number", F.explode("jobs").alias("j")).select("delivery_no", "organisation_number", "j.job_id", "j.source_url").where("job_id is not null").distinct()
    looked = after.select("delivery_no", "organisation_number", F.transform("sources", lambda s: s["url"]).alias("urls"))
    return history.removed_or_unseen(items(before), items(after), ["delivery_no", "organisation_number", "job_id"], "source_url", looked, "delivery_no", "organisation_number")


@query("""WITH h AS (SELECT organisation_number, arg_max_null(profile_hash, struct_pack(d := delivery_no, c := captured_at)) AS head FROM snapshots WHERE delivery_no < 4 GROUP BY 1),
n AS (SELECT organisation_number, arg_max_null(profile_hash, captured_at) AS profile_hash FROM snapshots WHERE delivery_no = 4 GROUP BY 1) SELECT organisation_number, profile_hash FROM n LEFT JOIN h USING (organisation_number) WHERE profile_hash IS DISTINCT FROM head""")
def new_log_heads(spark, folder):
    rows = load(spark, folder, "snapshots").select("organisation_number", "delivery_no", "captured_at", "profile_hash")
    last = rows.where("delivery_no = 4").groupBy("organisation_number").agg(F.max_by("profile_hash", "captured_at").alias("profile_hash"))
    return history.new_heads(rows.where("delivery_no < 4"), last, "organisation_number", "profile_hash", F.struct("delivery_no", "captured_at"))


@query("""SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE ts IS NOT NULL AND ts <= TIMESTAMP '2024-06-30 00:00:00') WHERE place <= 20""")
def timeline(spark, folder):
    rows = load(spark, folder, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return history.timeline(rows, "user_id", "ts", F.lit("2024-06-30 00:00:00").cast("timestamp"), 20, [F.col("event_id")]).select("user_id", "event_id", "place")


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, max(CAST(round(o_totalprice) AS BIGINT)) AS amount FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS rn, lead(amount) OVER (PARTITION BY o_custkey ORDER BY y DESC) AS nxt, lead(y) OVER (PARTITION BY o_custkey ORDER BY y DESC) AS ny FROM y)
SELECT o_custkey, CAST(y AS INT) AS y, amount, nxt AS before, CASE WHEN nxt <> 0 THEN round_even((amount - nxt) / abs(nxt) * 100, 1) + 0.0 END AS change_pct FROM r WHERE rn = 1""")
def yearly_trend(spark, folder):
    rows = load(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.round("o_totalprice").cast("bigint").alias("amount"))
    return history.trend(rows, "o_custkey", "y", "amount")


# Candidates


@query(f"""WITH n AS (SELECT candidate_id, url, rank, {_CANONICAL.format("url")} AS address FROM (SELECT DISTINCT candidate_id, url, rank FROM candidates))
SELECT host, address, candidate_id FROM (SELECT {_HOST.format("url")} AS host, address, candidate_id, row_number() OVER (PARTITION BY {_HOST.format("url")}, address ORDER BY rank, candidate_id) AS rn FROM n WHERE address IS NOT NULL) WHERE rn = 1""")
def first_of_address(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", "url", "rank", urls.host(F.col("url")).alias("host")).distinct()
    return candidates.first_of_address(rows, "host", "url", [F.col("rank"), F.col("candidate_id")]).select("host", "address", "candidate_id")


_WALK = f"""w0 AS (SELECT candidate_id, {_HOST.format("url")} AS host, rank, coalesce(rejection_reason IN ('parked_domain', 'generic_aggregator'), false) AS skip, coalesce(identity_score >= 0.9, false) AS hit FROM (SELECT DISTINCT candidate_id, url, rank, rejection_reason, identity_score FROM candidates) WHERE url IS NOT NULL),
w1 AS (SELECT *, coalesce(sum(CASE WHEN skip THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY rank, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM w0),
w2 AS (SELECT *, coalesce(max(CASE WHEN hit AND NOT skip AND n < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY rank, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM w1),
walked AS (SELECT candidate_id, host, CASE WHEN done = 1 THEN 'early_end' WHEN skip THEN 'skipped' WHEN n >= 3 THEN 'capped' WHEN hit THEN 'verified' ELSE 'rejected' END AS outcome FROM w2)"""


def _walked(spark, folder):
    rows = load(spark, folder, "candidates").select("candidate_id", "url", "rank", "rejection_reason", "identity_score").distinct().where("url is not null").withColumn("host", urls.host(F.col("url")))
    return candidates.walk(rows, "host", [F.col("rank"), F.col("candidate_id")], F.col("rejection_reason").isin("parked_domain", "generic_aggregator"), F.col("identity_score") >= 0.9, 3)


@query(f"WITH {_WALK} SELECT * FROM walked")
def funnel_walk(spark, folder):
    return _walked(spark, folder).select("candidate_id", "host", "outcome")


@query(f"""WITH {_WALK} SELECT host, count(*) AS candidates, count(*) FILTER (outcome IN ('verified', 'rejected')) AS fetched, count(*) FILTER (outcome = 'verified') AS verified,
  CASE WHEN count(*) FILTER (outcome IN ('verified', 'rejected')) > 0 THEN round_even(count(*) FILTER (outcome = 'verified') / count(*) FILTER (outcome IN ('verified', 'rejected')), 3) END AS yield FROM walked GROUP BY 1""")
def funnel_metrics(spark, folder):
    return candidates.walk_summary(_walked(spark, folder), "host")


@query()
def domain_candidates(spark, folder):
    """Addresses that each company may have; the spellings are tested on small frames."""
    return candidates.domain_candidates(_registry(spark, folder, "name", "municipality", "email"), "organisation_number", "name", "municipality", "email")


# Extraction


@query(r"""WITH p AS (SELECT fetch_id, body, regexp_replace(regexp_replace(body, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') AS b FROM fetch_results WHERE body IS NOT NULL)
SELECT fetch_id, CASE WHEN regexp_extract(b, '(?is)<title\b[^>]*>(.*?)</title>', 1) <> '' THEN trim(regexp_replace(replace(regexp_replace(regexp_extract(b, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) END AS title,
  CASE WHEN regexp_extract(b, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) <> '' THEN trim(regexp_replace(replace(regexp_replace(regexp_extract(b, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) END AS headline,
  CAST(len(list_distinct(list_filter(regexp_extract_all(b, '(?i)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)', 1), lambda x: x <> ''))) AS INT) AS links FROM p""")
def html_facts(spark, folder):
    return extract.html_facts(load(spark, folder, "fetch_results"), "fetch_id", "body")


@query("SELECT fetch_id, json_extract_string(body, '$.organisasjonsnummer') AS number, json_extract_string(body, '$.navn') AS name, json_extract_string(body, '$.antallAnsatte') AS staff FROM fetch_results WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) IN ('OBJECT', 'ARRAY')")
def json_answers(spark, folder):
    rows = extract.json_fields(load(spark, folder, "fetch_results").where(extract.is_json(F.col("body"))), "body", {"number": "$.organisasjonsnummer", "name": "$.navn", "staff": "$.antallAnsatte"})
    return rows.select("fetch_id", "number", "name", "staff")


# Screens


def _screen_base(spark, folder):
    money = load(spark, folder, "evidence").where("field = 'financials' and status = 'available'").select(
        "organisation_number", F.get_json_object("value", "$.revenue").try_cast("bigint").alias("revenue"), F.get_json_object("value", "$.year").try_cast("int").alias("year")
    )
    newest = money.where("revenue is not null").groupBy("organisation_number").agg(F.max_by("revenue", F.struct("year", "revenue")).alias("revenue"))
    base = _registry(spark, folder, "name", "legal_form", "employees", "municipality", "industry_code", "industry_label", "website").select("organisation_number", "name", "legal_form", "employees", "municipality", F.concat_ws(" ", "industry_code", "industry_label").alias("industry"), "website")
    return base.join(newest, "organisation_number", "left").withColumns({"financials": F.col("revenue").isNotNull(), "annual_result": F.lit(None).cast("bigint")})


_SCREEN = f"""{_REGISTRY}, m AS (SELECT organisation_number, max_by(revenue, struct_pack(y := y, r := revenue)) AS revenue FROM (SELECT organisation_number, TRY_CAST(json_extract_string(value, '$.revenue') AS BIGINT) AS revenue, TRY_CAST(json_extract_string(value, '$.year') AS INT) AS y FROM evidence WHERE field = 'financials' AND status = 'available') WHERE revenue IS NOT NULL GROUP BY 1),
base AS (SELECT reg.organisation_number, reg.legal_form, reg.employees, reg.municipality, reg.website, m.revenue, concat_ws(' ', reg.industry_code, reg.industry_label) AS industry FROM reg LEFT JOIN m USING (organisation_number))"""


def _screened(spark, folder, words):
    return screen.run(_screen_base(spark, folder), screen.parse(words)).select("organisation_number", "employees", "revenue")


@query(f"WITH {_SCREEN} SELECT organisation_number, employees, revenue FROM base WHERE lower(municipality) = 'hummeleidet' AND revenue > 10000000 ORDER BY revenue DESC NULLS LAST, organisation_number LIMIT 10")
def screen_top_by_revenue(spark, folder):
    return _screened(spark, folder, "companies in Hummeleidet with revenue over 10 million top 10 by revenue")


@query(f"WITH {_SCREEN} SELECT organisation_number, employees, revenue FROM base WHERE lower(legal_form) = 'as' AND employees >= 5 AND trim(coalesce(website, '')) <> ''")
def screen_filters(spark, folder):
    return _screened(spark, folder, "companies with a website and at least 5 employees and legal form AS")


@query(f"WITH {_SCREEN} SELECT organisation_number, employees, revenue FROM base WHERE contains(lower(industry), 'fisk')")
def screen_contains(spark, folder):
    return _screened(spark, folder, "companies where industry contains 'fisk'")


@query(f"WITH {_SCREEN} SELECT organisation_number, employees, revenue FROM base ORDER BY employees DESC NULLS LAST, organisation_number LIMIT 25")
def screen_nulls_last(spark, folder):
    return _screened(spark, folder, "top 25 by employees")


@query("SELECT organisation_number, employees, CAST(NULL AS BIGINT) AS revenue FROM registry WHERE false")
def screen_abstains(spark, folder):
    return _screened(spark, folder, "companies in Hummeleidet with good sentiment")


@query("SELECT job_id, 'job-' || substring(sha256(concat_ws('|', coalesce(company_orgnr, 'None'), coalesce(source_url, 'None'))), 1, 16) AS derived_id FROM (SELECT DISTINCT job_id, company_orgnr, source_url FROM jobs)")
def derived_ids(spark, folder):
    rows = load(spark, folder, "jobs").select("job_id", "company_orgnr", "source_url").distinct()
    return rows.select("job_id", F.concat(F.lit("job-"), F.substring(content_hash(F.col("company_orgnr"), F.col("source_url")), 1, 16)).alias("derived_id"))


# Facts, gaps, signals

_FACT_COLUMNS = ("organisation_number", "field", "value", "source_url", "retrieved_at", "content_sha256")
_PATHS = {"registry": ["employees"], "registry_live": ["employees"], "financials": ["revenue", "year"], "website": ["host", "count"], "roles": ["host", "count"]}


@query(f"""WITH {_EVIDENCE}, k AS (SELECT * FROM ev WHERE state = 'available' AND source_url IS NOT NULL AND retrieved_at IS NOT NULL AND content_sha256 IS NOT NULL),
c AS (SELECT *, unnest(CASE WHEN field IN ('registry', 'registry_live') THEN ['employees'] WHEN field = 'financials' THEN ['revenue', 'year'] WHEN field IN ('website', 'roles') THEN ['host', 'count'] END) AS claim FROM k)
SELECT DISTINCT organisation_number, field AS module, claim, json_extract_string(value, '$.' || claim) AS value, source_url, retrieved_at, content_sha256 FROM c WHERE json_extract_string(value, '$.' || claim) IS NOT NULL""")
def company_facts(spark, folder):
    return synthesis.facts(_evidence(spark, folder, *_FACT_COLUMNS), _PATHS)


@query(f"""WITH {_EVIDENCE} SELECT DISTINCT organisation_number, field AS module, unnest(['revenue', 'year']) AS claim, json_extract_string(value, unnest(['$.revenue', '$.year'])) AS value FROM ev
WHERE field = 'financials' AND state = 'available' AND source_url IS NOT NULL AND retrieved_at IS NOT NULL AND content_sha256 IS NOT NULL AND json_extract_string(value, '$.revenue') IS NOT NULL AND json_extract_string(value, '$.year') IS NOT NULL""")
def answer_on_revenue(spark, folder):
    known = synthesis.facts(_evidence(spark, folder, *_FACT_COLUMNS), _PATHS)
    return synthesis.answer(known, "What was the revenue?").select("organisation_number", "module", "claim", "value").distinct()


@query(f"""WITH {_REGISTRY}, {_EVIDENCE}, b AS (SELECT organisation_number, field AS module, bool_or(state = 'available') AS ok, min(state) AS state FROM ev GROUP BY 1, 2),
w AS (SELECT organisation_number, unnest(['registry', 'registry_live', 'financials', 'roles', 'group', 'locations', 'website', 'accounting_obligation', 'external_footprint']) AS module FROM reg)
SELECT w.organisation_number, w.module, coalesce(b.state, 'missing') AS state FROM w LEFT JOIN b USING (organisation_number, module) WHERE NOT coalesce(b.ok, false)""")
def unknown_modules(spark, folder):
    return synthesis.unknowns(_registry(spark, folder), _evidence(spark, folder, "organisation_number", "field"))


@query("""SELECT company_orgnr AS organisation_number, 'postings' AS signal, count(*) AS n FROM (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, ingested_at) WHERE identity_assessment.score >= 0.9 AND company_orgnr IS NOT NULL GROUP BY 1
UNION ALL SELECT company_orgnr, 'news', count(*) FROM (SELECT DISTINCT ON (activity_id) * FROM activities ORDER BY activity_id, ingested_at) WHERE activity_type = 'news' AND company_orgnr IS NOT NULL GROUP BY 1""")
def growth_signals(spark, folder):
    jobs = ranking.keep_first(load(spark, folder, "jobs"), ["job_id"], [F.col("ingested_at")]).withColumnRenamed("company_orgnr", "organisation_number")
    news = ranking.keep_first(load(spark, folder, "activities"), ["activity_id"], [F.col("ingested_at")]).withColumnRenamed("company_orgnr", "organisation_number")
    named = F.col("organisation_number").isNotNull()
    return synthesis.signals({"postings": (jobs, named & (F.col("identity_assessment.score") >= 0.9)), "news": (news, named & (F.col("activity_type") == "news"))})


@query(f"WITH {_REGISTRY}, s AS (SELECT organisation_number, sha256('s1:' || organisation_number) AS h FROM reg ORDER BY 2, 1 LIMIT 50) SELECT sha256(string_agg(organisation_number, chr(10) ORDER BY organisation_number)) AS set_hash, sha256(string_agg(organisation_number, '' ORDER BY h)) AS sequence_hash FROM s")
def sample_hashes(spark, folder):
    sample = hash_rank_sample(spark, folder)
    return sample.agg(set_hash(F.col("organisation_number")).alias("set_hash"), sequence_hash(F.col("organisation_number"), F.col("rank_hash")).alias("sequence_hash"))


@query("SELECT host AS organisation_number, candidate_id FROM (SELECT organisation_number AS host, fetch_id AS candidate_id, row_number() OVER (PARTITION BY organisation_number ORDER BY bytes_received DESC NULLS LAST, fetch_id) AS rn FROM fetch_results) WHERE rn = 1")
def largest_page(spark, folder):
    rows = load(spark, folder, "fetch_results").select("organisation_number", "fetch_id", "bytes_received")
    return ranking.best_of(rows, ["organisation_number"], F.col("bytes_received"), [F.col("fetch_id")]).select("organisation_number", F.col("fetch_id").alias("candidate_id"))


_KINDS = [("award", "pris(en)?\\b|award"), ("launch", "åpner|lansér|opens|launch"), ("agreement", "avtale|contract|sammen"), ("event", "fagdag|messen|årsmøte")]


@query(r"""SELECT activity_id, CASE WHEN regexp_matches(t, '(?i)pris(en)?\b|award') THEN 'award' WHEN regexp_matches(t, '(?i)åpner|lansér|opens|launch') THEN 'launch' WHEN regexp_matches(t, '(?i)avtale|contract|sammen') THEN 'agreement' WHEN regexp_matches(t, '(?i)fagdag|messen|årsmøte') THEN 'event' END AS kind
FROM (SELECT DISTINCT activity_id, coalesce(title, '') AS t FROM activities)""")
def activity_kinds(spark, folder):
    rows = load(spark, folder, "activities").select("activity_id", F.coalesce("title", F.lit("")).alias("t")).distinct()
    return rows.select("activity_id", text.first_rule(_KINDS, F.col("t")).alias("kind"))
