"""Whether a page is of a company: features first, then one ordered list of rules.

The first rule that holds gives score and reason, so their order is the meaning.
Rules are data: a caller may pass others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions.names import is_branch, site_root
from tindra.functions.text import compact, digits, tokens
from tindra.functions.urls import host

#: Page titles that tell an error or an empty site.
ERROR_WORDS = r"(?i)\b(404|not found|siden finnes ikke|page not found|forbidden|internal server error)\b"
PARKED_WORDS = r"(?i)(domain is parked|domenet er til salgs|domain is for sale|kommer snart|under oppussing|index of /)"


def with_features(df: DataFrame, name: str, number: str, email: str, place: str, url: str, title: str, text: str, website: str | None = None, phone: str | None = None, street: str | None = None, code: str | None = None) -> DataFrame:
    """Adds the features of (company, page) rows; nulls count as not said.

    ``text`` may be markup.  Words of the name are looked for in all of it but scripts
    and styles (embedded JSON-LD counts: it names the company), numbers, the street and
    the place in all of it.  ``website``, ``phone``, ``street`` and post ``code`` are what is registered.
    """
    none = F.lit(None).cast("string")
    given = {k: F.col(c) if c else none for k, c in (("website", website), ("phone", phone), ("street", street), ("code", code))}
    wanted = tokens(F.col(name))
    shown = F.regexp_replace(F.col(text), r"(?is)<(script|style)\b(?![^>]*ld\+json).*?</\1>", " ")
    said = tokens(F.concat_ws(" ", F.col(title), shown))
    mail_host = F.lower(F.regexp_extract(F.col(email), r"@([^@\s>]+)$", 1))
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?<=\d)[ .](?=\d{3})", "")
    numbers = F.regexp_extract_all(plain, F.lit(r"(?<!\d)(\d{9})(?!\d)"), F.lit(1))
    flat = compact(F.concat_ws(" ", F.col(title), F.col(text)))
    head = compact(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\s[|»–-]\s.*$", ""))
    root = site_root(F.col(url))
    on = lambda own: F.coalesce((own != "") & ((host(F.col(url)) == own) | host(F.col(url)).endswith(F.concat(F.lit("."), own))), F.lit(False))
    called = digits(given["phone"])
    no = F.lit(False)
    return df.withColumns(
        {
            "name_words": F.size(wanted),
            "shared_words": F.size(F.array_intersect(wanted, said)),
            "whole_name": (compact(F.array_join(wanted, "")) != "") & F.contains(compact(F.col(title)), compact(F.array_join(wanted, ""))),
            "exact_title": (F.size(wanted) > 0) & ((head == F.array_join(wanted, "")) | (head == compact(F.col(name)))),
            "name_in_host": F.coalesce(F.contains(F.regexp_replace(host(F.col(url)), "[^a-z0-9]", ""), F.array_join(F.slice(wanted, 1, 2), "")) & (F.size(wanted) > 0), no),
            "mail_matches": on(mail_host),
            "registered_site": on(host(given["website"])),
            "brand_in_title": F.exists(tokens(F.col(title)), lambda w: (F.length(w) >= 4) & F.contains(root, w)),
            "branch_of_site": F.coalesce(is_branch(F.coalesce(F.col(name), F.lit("")), root, F.col(place)), no),
            "own_number": F.coalesce(F.array_contains(numbers, digits(F.col(number))), no),
            "other_number": F.coalesce(F.size(F.array_except(numbers, F.array(digits(F.col(number))))) > 0, no),
            "phone_said": F.coalesce((F.length(called) >= 8) & F.contains(digits(plain), F.right(called, F.lit(8))), no),
            "street_said": F.coalesce((F.length(compact(given["street"])) >= 6) & F.contains(flat, compact(given["street"])), no),
            "code_said": F.coalesce(given["code"].rlike("^[0-9]{4}$") & F.contains(F.col(text), given["code"]), no),
            "place_said": F.coalesce((compact(F.col(place)) != "") & F.contains(flat, compact(F.col(place))), no),
            "is_error": F.coalesce(F.col(title).rlike(ERROR_WORDS), no),
            "is_parked": F.coalesce(F.col(title).rlike(PARKED_WORDS), no),
            "is_substantial": F.length(F.coalesce(F.col(text), F.lit(""))) >= 100,
        }
    )


def rules() -> list[tuple[str, Column, float]]:
    """(reason, condition, score) in order."""
    c = F.col
    ratio = c("shared_words") / F.greatest(c("name_words"), F.lit(1))
    strong = c("street_said") | (c("code_said") & c("place_said"))
    linked = c("registered_site") | c("mail_matches") | c("name_in_host")
    return [
        ("error page", c("is_error"), 0.1),
        ("parked page", c("is_parked"), 0.1),
        ("own number", c("own_number") & ~c("other_number"), 1.0),
        ("number of another company", c("other_number") & ~c("own_number"), 0.2),
        ("registered site and mail host", c("registered_site") & c("mail_matches") & ~c("other_number"), 0.92),
        ("host guessed from the name, page does not name it", ~c("registered_site") & ~c("mail_matches") & c("name_in_host") & (c("shared_words") == 0), 0.85),
        ("name as title", c("exact_title") & linked & ((c("name_words") >= 2) | c("is_substantial")), 0.95),
        ("name as title, nothing links it", c("exact_title"), 0.85),
        ("name and address or telephone", ((ratio >= 0.75) & strong) | (c("phone_said") & (c("shared_words") >= 1)), 0.95),
        ("mail host and name", c("mail_matches") & (c("shared_words") >= 1), 0.95),
        ("registered site and its brand", c("registered_site") & c("brand_in_title") & c("is_substantial"), 0.9),
        ("branch of the registered site", c("registered_site") & c("branch_of_site") & c("is_substantial"), 0.9),
        ("whole name and place", c("whole_name") & c("place_said"), 0.95),
        ("whole name in title and host", c("whole_name") & c("name_in_host") & c("is_substantial"), 0.92),
        ("whole name only", c("whole_name"), 0.85),
        ("most of the name and place", (ratio >= 0.75) & (c("shared_words") >= 2) & c("place_said"), 0.9),
        ("most of the name", (ratio >= 0.75) & (c("shared_words") >= 2), 0.85),
        ("half of the name", (ratio >= 0.5) & (c("shared_words") >= 2), 0.65),
    ]


def assess(df: DataFrame, ordered: list[tuple[str, Column, float]] | None = None, otherwise: tuple[str, float] = ("too little", 0.3)) -> DataFrame:
    """Adds ``score``, ``reason`` and ``status``: exact from .9, review from .8, else uncertain."""
    chosen = None
    for reason, condition, score in ordered if ordered is not None else rules():
        value = F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        holds = F.coalesce(condition, F.lit(False))
        chosen = F.when(holds, value) if chosen is None else chosen.when(holds, value)
    last = F.struct(F.lit(otherwise[1]).alias("score"), F.lit(otherwise[0]).alias("reason"))
    judged = df.withColumn("_j", chosen.otherwise(last) if chosen is not None else last)
    status = F.when(F.col("_j.score") >= 0.9, "exact").when(F.col("_j.score") >= 0.8, "review").otherwise("uncertain")
    return judged.withColumns({"score": F.col("_j.score"), "reason": F.col("_j.reason"), "status": status}).drop("_j")


#: Words that many companies have in their names; alone they name none.
GENERIC_WORDS = ("norge", "norway", "norsk", "nordic", "bygg", "eiendom", "service", "gruppen", "group", "holding", "invest", "drift", "transport", "consulting", "data", "energi", "helse")


def social_rules() -> list[tuple[str, Column, float]]:
    """(reason, condition, score), in order, over the features of ``with_social_features``."""
    c = F.col
    return [
        ("account of a platform", c("is_platform"), 0.1),
        ("other legal form", c("other_form"), 0.3),
        ("generic words only", c("generic_only"), 0.3),
        ("whole name", (c("name_words") > 0) & c("whole_in_account"), 0.98),
        ("single word of the name", (c("name_words") == 1) & (c("shared_words") == 1), 0.95),
        ("most of the name", (c("shared_words") >= 2) & (c("shared_words") >= 0.75 * c("name_words")), 0.9),
        ("name of the site", ~c("is_branch") & c("is_site_name"), 0.92),
    ]


def with_social_features(df: DataFrame, name: str, legal_form: str, url: str, root: Column, branch: Column) -> DataFrame:
    """Adds the features of (company, profile) rows; ``root`` is the name of the verified site, ``branch`` whether the company is a branch of whom that belongs to."""
    from tindra.functions.names import PLATFORM_ACCOUNTS, account, account_is_site
    from tindra.functions.urls import path

    words, handle = tokens(F.col(name)), account(F.col(url))
    parts = tokens(path(F.col(url)), legal_words=True)
    said = F.filter(words, lambda w: F.contains(compact(path(F.col(url))), w))
    forms = ("as", "asa", "da", "ans", "sa", "nuf", "ab", "enk", "ks", "iks")
    return df.withColumns(
        {
            "name_words": F.size(words),
            "shared_words": F.size(said),
            "whole_in_account": F.contains(compact(path(F.col(url))), F.array_join(words, "")),
            "generic_only": (F.size(said) > 0) & F.forall(said, lambda w: w.isin(*GENERIC_WORDS)),
            "is_platform": handle.isin(*PLATFORM_ACCOUNTS),
            "other_form": F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda w: w.isin(*forms) & (w != F.lower(F.coalesce(F.col(legal_form), F.lit(""))))),
            "is_branch": F.coalesce(branch, F.lit(False)),
            "is_site_name": F.coalesce(account_is_site(handle, root), F.lit(False)),
        }
    )


def assess_social(df: DataFrame) -> DataFrame:
    """Adds ``score``, ``reason`` and ``status`` to rows with social features."""
    return assess(df, social_rules(), ("no strong sign of the name", 0.3))


def gated(pages: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, publishable, kept, quarantined): whether a company's page is taken for its own, and of the profiles it links how many are kept.

    A profile is kept when the page and the profile are both exact.
    """
    page = pages.groupBy(key).agg(F.max(F.col("status") == "exact").alias("publishable"))
    counts = profiles.groupBy(key).agg(F.count_if(F.col("status") == "exact").alias("_exact"), F.count("*").alias("_all"))
    joined = page.join(counts, key, "left").na.fill(0, ["_exact", "_all"])
    kept = F.when(F.col("publishable"), F.col("_exact")).otherwise(0)
    return joined.select(key, "publishable", kept.alias("kept"), (F.col("_all") - kept).alias("quarantined"))
