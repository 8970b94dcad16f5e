"""Candidate addresses of companies, their scores, and the walk through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions.text import compact, folded, tokens
from tindra.functions.urls import blocked, canonical, host

# Mail hosts that many people share.
SHARED_MAIL = ("gmail.com", "hotmail.com", "outlook.com", "online.no", "yahoo.com", "live.no", "icloud.com")


def domain_candidates(companies: DataFrame, key: str, name: str, municipality: str, email: str, most: int = 14, endings: tuple[str, ...] = ("no", "com")) -> DataFrame:
    """(key, url, tier, place): addresses that a company may have, told from its name and mail; at most ``most`` of each.

    Tier 1 joins the words of the name, tier 2 hyphenates and shortens them, tier 3
    spells its letters out; tier 0 is the mail's host.  Built as arrays within the row,
    so nothing is shuffled.
    """
    words = tokens(F.col(name))
    place = tokens(F.col(municipality))
    inner = F.filter(words, lambda w: ~F.array_contains(F.coalesce(place, F.array().cast("array<string>")), w))
    join = lambda a, sep="": F.array_join(a, sep)
    first = lambda n: F.slice(words, 1, n)
    spelled = F.regexp_replace(F.replace(F.replace(F.replace(F.lower(F.col(name)), F.lit("ø"), F.lit("oe")), F.lit("å"), F.lit("aa")), F.lit("æ"), F.lit("ae")), r"\b(as|asa|ans|da|sa|nuf)\b|[^a-z0-9]", "")
    mail = F.lower(F.regexp_extract(F.col(email), r"@([^@\s>]+)$", 1))
    stems = [
        (1, join(words)), (1, F.element_at(words, 1)), (1, join(first(2))), (1, join(inner)), (1, join(first(3))),
        (2, join(words, "-")), (2, join(first(2), "-")), (2, F.concat(join(words), F.lit("as"))), (2, F.when(F.size(words).between(3, 4), join(F.transform(words, lambda w: F.substring(w, 1, 1))))),
        (3, spelled), (3, F.concat(join(words), F.lit("gruppen"))),
    ]
    entry = lambda tier, url: F.struct(F.lit(tier).alias("tier"), url.alias("url"))
    options = [entry(0, F.when((mail != "") & ~mail.isin(*SHARED_MAIL), F.concat(F.lit("https://"), mail)))]
    for tier, stem in stems:
        for ending in endings[: 2 if tier == 1 else 1]:
            options.append(entry(tier, F.when(F.length(stem).between(3, 40), F.concat(F.lit("https://"), stem, F.lit("." + ending)))))
    found = F.filter(F.array(*options), lambda x: x["url"].isNotNull())
    rows = companies.where(F.size(words) > 0).select(F.col(key), found.alias("_c")).withColumn("_u", F.transform("_c", lambda x: x["url"]))
    keep = F.filter("_c", lambda x, k: F.array_position(F.col("_u"), x["url"]) == k + 1)
    rows = rows.select(F.col(key), F.posexplode(F.slice(keep, 1, most)).alias("place", "c"))
    return rows.select(key, "c.url", "c.tier", (F.col("place") + 1).alias("place"))


def first_of_address(candidates: DataFrame, key: str, url: str, order: list[Column]) -> DataFrame:
    """One candidate of each key and canonical address, the first in order; adds ``address``."""
    named = candidates.withColumn("address", canonical(F.col(url))).where("address is not null")
    w = Window.partitionBy(key, "address").orderBy(*order)
    return named.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def name_score(name: Column, title: Column, url: Column, place: Column, seen_place: Column) -> Column:
    """How well a page fits a name, between 0 and 1: the name in its title, in its host, and its place."""
    wanted = tokens(name)
    covered = F.size(F.array_intersect(wanted, tokens(title))) / F.greatest(F.size(wanted), F.lit(1))
    in_host = F.contains(F.regexp_replace(folded(host(url)), "[^a-z0-9]", ""), F.element_at(F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("?"))), 1))
    score = 0.45 * covered + F.when(F.coalesce(in_host, F.lit(False)), 0.3).otherwise(0.0) + F.when((compact(place) == compact(seen_place)) & (compact(place) != ""), 0.25).otherwise(0.0)
    return F.bround(F.least(score, F.lit(1.0)), 4)


def walk(candidates: DataFrame, key: str, order: list[Column], skipped: Column, verified: Column, most: int) -> DataFrame:
    """Adds ``outcome`` to candidates that are tried in order until one is verified or ``most`` were tried.

    skipped: never tried and costs nothing; after a verified one: early_end; beyond
    ``most``: capped; else verified or rejected.  ``order`` has to be total and ascending.

    Only the first ``most`` that are tried decide where a walk ends, and a group limit
    leaves no more than those of each key; every candidate is then compared with the two
    places at which its walk ended, so a key of any number of candidates is never in one task.
    """
    tagged = candidates.withColumns({"_skip": F.coalesce(skipped, F.lit(False)), "_hit": F.coalesce(verified, F.lit(False)), "_at": F.struct(*order)})
    w = Window.partitionBy(key).orderBy(*order)
    tried = tagged.where(~F.col("_skip")).select(key, "_at", "_hit", F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= most)
    ends = tried.groupBy(key).agg(F.min(F.when(F.col("_hit"), F.col("_at"))).alias("_won"), F.max(F.when(F.col("_rn") == most, F.col("_at"))).alias("_last"))
    ends = ends.withColumnRenamed(key, "_k")
    joined = tagged.join(ends, F.col(key).eqNullSafe(F.col("_k")), "left")
    over = lambda end: F.coalesce(F.col("_at") > F.col(end), F.lit(False))
    outcome = F.when(over("_won"), "early_end").when(F.col("_skip"), "skipped").when(over("_last"), "capped").when(F.col("_hit"), "verified").otherwise("rejected")
    return joined.withColumn("outcome", outcome).drop("_skip", "_hit", "_at", "_k", "_won", "_last")


def walk_summary(walked: DataFrame, key: str) -> DataFrame:
    """(key, candidates, fetched, verified, yield): what the walk came to; a yield over nothing is null."""
    fetched = F.count_if(F.col("outcome").isin("verified", "rejected"))
    sums = walked.groupBy(key).agg(F.count("*").alias("candidates"), fetched.alias("fetched"), F.count_if(F.col("outcome") == "verified").alias("verified"))
    return sums.withColumn("yield", F.bround(F.try_divide("verified", "fetched"), 3))


def first_provider(results: DataFrame, key: str, provider: str, preference: tuple[str, ...]) -> DataFrame:
    """The results of each key from the first provider, in order of preference, that has any; providers that are not named come last, by name."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in preference)), F.col(provider)), F.lit(0))
    rank = F.struct(F.when(place > 0, place).otherwise(len(preference) + 1).alias("p"), F.coalesce(provider, F.lit("")).alias("n"))
    best = results.groupBy(key).agg(F.min(rank).alias("_best")).withColumnRenamed(key, "_k")
    return results.join(best, (F.col(key).eqNullSafe(F.col("_k"))) & (rank == F.col("_best"))).drop("_k", "_best")


def search_phrases(companies: DataFrame, key: str, name: str, municipality: str, email: str) -> DataFrame:
    """(key, place, phrase): what to search for a company by, from narrow to wide; each phrase once, companies without name have none."""
    clean = F.trim(F.regexp_replace(F.col(name), r"\s+", " "))
    bare = F.trim(F.regexp_replace(clean, r" (AS|ASA|ENK|DA|ANS|NUF|SA|BRL|ESEK)$", ""))
    town = F.coalesce(F.when(F.trim(F.col(municipality)) != "", F.trim(F.col(municipality))), F.lit("Norge"))
    mail = F.regexp_replace(F.lower(F.regexp_extract(F.col(email), r"@([^@\s>]+)$", 1)), r"^www\.", "")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    phrases = F.array(
        quoted(clean), F.concat(quoted(clean), F.lit(" "), F.regexp_replace(F.col(key), "[^0-9]", "")), F.concat(quoted(bare), F.lit(" "), town), F.concat(quoted(clean), F.lit(" "), town),
        F.when(F.contains(mail, F.lit(".")) & ~mail.isin(*SHARED_MAIL), F.concat(quoted(bare), F.lit(" "), mail)),
    )
    return companies.where(clean != "").select(key, F.posexplode(F.array_distinct(F.array_compact(phrases))).alias("_p", "phrase")).select(key, (F.col("_p") + 1).alias("place"), "phrase")


def company_candidates(companies: DataFrame, key: str, name: str, municipality: str, email: str, website: str, most: int = 18) -> DataFrame:
    """(key, url, tier, place): where to look for a company's site, in order and at most ``most``.

    First the registered site, then a mail host that carries a word of the name, the
    full name as a domain, other mail hosts, then the other spellings of the name in
    their order.  Of two equal addresses the first counts.  Within the row, no shuffle
    but the one that brings the spellings together.
    """
    spelled = domain_candidates(companies, key, name, municipality, email, most=most).where("tier > 0")
    listed = spelled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("_s"))  # at most ``most`` of a company
    rows = companies.select(key, name, email, website).join(listed, key, "left")
    words = F.filter(tokens(F.col(name)), lambda w: F.length(w) >= 3)
    mail = F.lower(F.regexp_extract(F.col(email), r"@([^@\s>]+)$", 1))
    address = F.when((mail != "") & F.contains(mail, F.lit(".")) & ~mail.isin(*SHARED_MAIL), canonical(mail))
    label = F.regexp_replace(F.substring_index(F.regexp_replace(mail, r"^www\.", ""), ".", 1), "[^a-z0-9]", "")
    named = F.exists(words, lambda w: F.contains(label, w)) | (F.size(words) == 0)
    entry = lambda tier, url: F.struct(F.lit(tier).alias("tier"), url.alias("url"))
    names = F.transform(F.coalesce("_s", F.array().cast("array<struct<place:int,url:string>>")), lambda x: x["url"])
    full = F.slice(names, 1, 2)
    options = F.concat(
        F.array(entry("registered site", canonical(F.when(F.trim(F.col(website)) != "", F.col(website)))), entry("mail host", F.when(named, address))),
        F.transform(full, lambda u: entry("full name", u)),
        F.array(entry("mail host", F.when(~named, address))),
        F.transform(F.slice(names, 3, most), lambda u: entry("spelling", u)),
    )
    found = F.filter(options, lambda x: x["url"].isNotNull())
    keep = F.filter(found, lambda x, k: F.array_position(F.transform(found, lambda y: y["url"]), x["url"]) == k + 1)
    return rows.select(key, F.posexplode(F.slice(keep, 1, most)).alias("_p", "c")).select(key, "c.url", "c.tier", (F.col("_p") + 1).alias("place"))


def relationship_candidates(companies: DataFrame, locations: DataFrame, key: str, email: str, most: int = 4) -> DataFrame:
    """(key, url, reason, place): addresses that a company's registrations lead to: its mail host, then of its first five sub-units in order their sites, mail hosts and names.

    ``locations`` has the key, ``place``, ``name``, ``website`` and ``email`` as from
    ``official.locations``.  At most ``most`` of a company, an address once.
    """
    at = lambda c: F.lower(F.regexp_extract(c, r"@([^@\s>]+)$", 1))
    usable = lambda h: F.when((h != "") & F.contains(h, F.lit(".")) & ~h.isin(*SHARED_MAIL), canonical(h))
    words = tokens(F.col("name"))
    joined = lambda sep: F.when(F.size(words) >= 2, F.concat(F.lit("https://"), F.get(words, F.lit(0)), F.lit(sep), F.get(words, F.lit(1)), F.lit(".no")))
    own = companies.select(key, F.lit(0).alias("_n"), F.lit(0).alias("_k"), usable(at(F.col(email))).alias("url"), F.lit("registered mail").alias("reason"))
    entry = lambda k, url, reason: F.struct(F.lit(k).alias("_k"), url.alias("url"), F.lit(reason).alias("reason"))
    options = F.array(entry(1, canonical(F.when(F.trim("website") != "", F.col("website"))), "sub-unit's site"), entry(2, usable(at(F.col("email"))), "sub-unit's mail"), entry(3, joined(""), "sub-unit's name"), entry(4, joined("-"), "sub-unit's name"))
    units = locations.where(F.col("place").between(1, 5)).select(key, F.col("place").alias("_n"), F.explode(options).alias("_e")).select(key, "_n", "_e.*")
    first = own.unionByName(units).where("url is not null").groupBy(key, "url").agg(F.min(F.struct("_n", "_k", "reason")).alias("_r"))
    w = Window.partitionBy(key).orderBy("_r._n", "_r._k", "url")  # a handful of rows
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(key, "url", "_r.reason", "place")


#: What each sign of a search result adds to its score.
RESULT_WEIGHTS = {"number": 0.75, "name in title": 0.45, "name": 0.25, "name in host": 0.3, "mail host": 0.35, "place": 0.1}


def result_score(name: Column, number: Column, place: Column, email: Column, url: Column, title: Column, snippet: Column, blocked_hosts: tuple[str, ...] = ()) -> Column:
    """(score, status) of a search result for a company: the weights of its signs, 1 at most.

    accepted needs .75, a tie of the host to the company and a strong sign beside it;
    review needs .6; hosts of directories are rejected unseen.
    """
    own = host(url)
    words, in_title, in_snippet, in_host = tokens(name), tokens(title), tokens(snippet), tokens(own)
    flat = F.array_join(in_host, "")
    holds = lambda inner, outer: (F.size(inner) > 0) & (F.size(F.array_except(inner, outer)) == 0)
    digits = F.regexp_replace(F.concat_ws(" ", title, snippet), "[^0-9]", "")
    mail = F.regexp_replace(F.lower(F.regexp_extract(email, r"@([^@\s>]+)$", 1)), r"^www\.", "")
    sign = {
        "number": F.contains(digits, F.regexp_replace(number, "[^0-9]", "")) & (F.regexp_replace(number, "[^0-9]", "") != ""),
        "name in title": holds(words, in_title),
        "name": holds(words, F.concat(in_title, in_snippet, in_host)),
        "name in host": (F.size(words) > 0) & F.forall(words, lambda w: F.contains(flat, w)),
        "mail host": (mail != "") & ((own == mail) | own.endswith(F.concat(F.lit("."), mail))),
        "place": holds(tokens(place), in_snippet),
    }
    sign = {k: F.coalesce(v, F.lit(False)) for k, v in sign.items()}
    points = lambda k: F.when(sign[k], RESULT_WEIGHTS[k]).otherwise(0.0)
    total = points("number") + F.when(sign["name in title"], RESULT_WEIGHTS["name in title"]).otherwise(points("name")) + points("name in host") + points("mail host") + points("place")
    score = F.bround(F.least(total, F.lit(1.0)), 2)
    tied = (sign["name in host"] | sign["mail host"]) & (sign["number"] | sign["name in title"] | (sign["name in host"] & (F.size(words) >= 2)))
    bad = own.isNull() | blocked(url, list(blocked_hosts))
    score = F.when(bad, 0.0).otherwise(score)
    return F.struct(score.alias("score"), F.when(bad, "rejected").when((score >= 0.75) & tied, "accepted").when(score >= 0.6, "review").otherwise("rejected").alias("status"))
