"""Addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tindra.functions.days import day_in_address

# Hosts of social platforms and words of paths, by what they tell.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com")
CAREER_WORDS = ("karriere", "jobb", "jobs", "careers", "stilling", "stillinger", "ledige-stillinger", "vacancies")
NEWS_WORDS = ("nyheter", "aktuelt", "news", "presse", "artikkel", "blogg", "blog")


def host(c: Column) -> Column:
    """Host in small letters without ``www.``, port and user; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^www\.", ""))


def path(c: Column) -> Column:
    """Path without query, fragment and closing slashes."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)$", 1), r"/+$", "")


def canonical(c: Column) -> Column:
    """``https``, host in small letters without ``www.``, path without closing slash; query and fragment dropped."""
    return F.when(host(c).isNotNull(), F.concat(F.lit("https://"), host(c), path(c)))


def segments(c: Column) -> Column:
    return F.filter(F.split(F.lower(path(c)), "/"), lambda s: s != "")


def in_scope(site: Column, url: Column) -> Column:
    """Whether an address is on the site: same host or below it, and below the site's path."""
    a, b = host(site), host(url)
    return ((b == a) | b.endswith(F.concat(F.lit("."), a))) & ((path(url) == path(site)) | F.startswith(path(url), F.concat(path(site), F.lit("/"))))


def blocked(c: Column, hosts: list[str]) -> Column:
    """Whether the host is one of those named or below one."""
    own = host(c)
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (own == h) | own.endswith("." + h)
    return F.coalesce(hit, F.lit(False))


def source_type(c: Column) -> Column:
    """social, careers, news or website, told from the address; null for no address."""
    has = lambda words: F.exists(segments(c), lambda s: s.isin(*words))
    return F.when(host(c).isNull(), None).when(blocked(c, list(SOCIAL_HOSTS)), "social").when(has(CAREER_WORDS), "careers").when(has(NEWS_WORDS), "news").otherwise("website")


# What tells sections, articles and postings in a path.
NEWS_PART = (
    "(^|-)(nyhet|nyheter|news|aktuelt|artikkel|artikler|article|articles|blogg?|presse?|pressemelding(er)?|"
    "press-releases?|siste-nytt|kunngjoring(er)?|newsroom|pressroom|innsikt|insights?|updates?|fagstoff)(-|$)"
)
NEWS_INDEX = (
    "nyheter", "news", "blog", "blogg", "aktuelt", "presse", "press", "artikler", "arkiv", "nyhetsarkiv", "media", "newsroom", "pressroom",
    "events", "arrangementer", "kunngjoringer", "pressemeldinger", "press-releases", "investors", "investor", "en", "no", "nb",
)
NO_ARTICLE = (
    "author", "tag", "tags", "category", "kategori", "page", "side", "search", "sok", "kontakt", "kontakt-oss", "contact", "contact-us", "om", "om-oss", "about", "about-us",
    "personvern", "privacy", "privacy-policy", "personvernerklaering", "cookies", "cookie-policy", "vilkar", "terms", "ansatte", "team", "people", "ledelse", "management",
    "karriere", "careers", "jobs", "jobb", "ledige-stillinger", "categories", "archive", "archives", "arkiv", "collections", "collection", "products", "produkter",
    "produkt", "product", "shop", "butikk", "nettbutikk", "register", "registrer", "bli-medlem", "medlemskap", "login", "logg-inn", "min-side", "checkout", "cart", "handlekurv", "kasse",
)
CAREER_PART = "(^|-)(karriere|stillinger?|jobb(er)?|careers?|vacanc(y|ies)|ledige-stillinger)(-|$)"
CAREER_INDEX = (
    "karriere", "careers", "career", "jobs", "jobb", "jobber", "stillinger", "ledige-stillinger", "ledige-jobber", "vacancies",
    "jobb-hos-oss", "rekruttering", "open-positions", "join-us", "bli-med-pa-laget", "en", "no", "nb",
)
NO_POSTING = (
    "personvern", "privacy", "privacy-policy", "cookies", "cookie-policy", "vilkar", "terms", "cart", "checkout", "login", "logg-inn",
    "handlekurv", "nettbutikk", "shop", "products", "produkter", "author", "tag", "tags",
)
OWN_LANGUAGES = ("no", "nb", "nn", "en", "nb-no", "no-nb", "nn-no", "no-no", "en-gb", "en-us")
PLATFORMS = {
    "linkedin.com": "linkedin", "facebook.com": "facebook", "instagram.com": "instagram", "x.com": "x", "twitter.com": "x",
    "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok",
}
NO_PROFILE = {
    "facebook": ("sharer", "sharer.php", "share.php", "share", "dialog", "policy.php", "privacy", "events", "groups", "plugins", "watch", "photo.php", "story.php", "permalink.php", "hashtag", "profile.php"),
    "instagram": ("p", "reel", "reels", "stories", "explore"),
    "x": ("intent", "share", "home", "search", "i"),
}
JOB_BOARDS = (
    "webcruiter.com", "webcruiter.no", "jobbnorge.no", "recman.no", "recman.page", "cruit.no", "easycruit.com", "hr-manager.net", "jobylon.com", "teamtailor.com", "reachmee.com",
    "cvideo.no", "smartrecruiters.com", "myworkdayjobs.com", "workday.com", "taleo.net", "successfactors.eu", "successfactors.com", "icims.com", "greenhouse.io", "lever.co",
    "personio.de", "personio.com", "recruitee.com", "workable.com", "homerun.co", "varbi.com", "emply.com", "karrierestart.no", "finn.no", "nav.no", "linkedin.com",
    "talentech.com", "talentech.io", "mojob.io", "candidatedna.com", "bamboohr.com", "breezy.hr", "zohorecruit.com", "freshteam.com", "jobtoolz.com", "ashbyhq.com",
    "pinpointhq.com", "recright.com", "grade.com", "intelliplan.eu", "intelliplan.se",
)


def _translated(parts: Column) -> Column:
    """Whether a path begins with the code of another language."""
    first = F.get(parts, F.lit(0))
    return first.rlike("^[a-z]{2}(-[a-z]{2})?$") & ~first.isin(*OWN_LANGUAGES)


def _section_at(parts: Column, pattern: str) -> Column:
    """The place, from 1, of the first segment of a section; 0 for none."""
    return F.coalesce(F.array_position(F.transform(parts, lambda s: s.rlike(pattern)), True), F.lit(0)).cast("int")


def is_article(c: Column) -> Column:
    """Whether an address is of one article below a news section rather than of the section, a listing or a translation."""
    parts = segments(c)
    last, at = F.try_element_at(parts, F.lit(-1)), _section_at(parts, NEWS_PART)
    named = (F.length(last) >= 8) & (last.rlike("[-_]") | day_in_address(path(c)).isNotNull())
    listing = last.isin(*NEWS_INDEX) | last.rlike("^[0-9]+$") | F.exists(parts, lambda s: s.isin(*NO_ARTICLE))
    return F.coalesce((F.size(parts) >= 2) & ~_translated(parts) & (at > 0) & (at < F.size(parts)) & ~listing & named, F.lit(False))


def is_posting(c: Column) -> Column:
    """Whether an address is of one posting below a careers section."""
    parts = segments(c)
    last, at = F.try_element_at(parts, F.lit(-1)), _section_at(parts, CAREER_PART)
    listing = last.isin(*CAREER_INDEX) | last.rlike("^[0-9]+$") | F.exists(parts, lambda s: s.isin(*NO_POSTING))
    return F.coalesce((F.size(parts) >= 2) & ~_translated(parts) & (at > 0) & (at < F.size(parts)) & ~listing & (F.length(last) >= 4), F.lit(False))


def is_careers_index(c: Column) -> Column:
    """Whether an address is of a careers page itself."""
    parts = segments(c)
    return F.coalesce(F.size(parts).between(1, 2) & F.try_element_at(parts, F.lit(-1)).isin(*(w for w in CAREER_INDEX if w not in ("en", "no", "nb"))), F.lit(False))


def news_section(c: Column) -> Column:
    """The path up to its news section; the whole path where it has none."""
    parts = segments(c)
    at = _section_at(parts, NEWS_PART)
    return F.array_join(F.slice(parts, 1, F.when(at > 0, at).otherwise(F.size(parts))), "/")


def social_profile(c: Column, hosts: dict[str, str] | None = None) -> Column:
    """(platform, url) of a profile on a social platform; null for other addresses, and for shares, posts and searches."""
    own = host(c)
    platform = F.lit(None).cast("string")
    for h, name in (hosts or PLATFORMS).items():
        platform = F.when((own == h) | own.endswith("." + h), name).otherwise(platform)
    parts = F.filter(F.split(path(c), "/"), lambda s: s != "")
    first, n = F.lower(F.get(parts, F.lit(0))), F.size(parts)
    no_page = F.lit(False)
    for name, words in NO_PROFILE.items():
        no_page = no_page | ((platform == name) & first.isin(*words))
    right = (
        F.when(platform == "linkedin", first.isin("company", "school", "showcase") & (n >= 2))
        .when(platform == "youtube", (first.isin("channel", "user", "c") | first.startswith("@")) & (own != "youtu.be"))
        .when(platform == "tiktok", first.startswith("@"))
        .when(platform == "x", n == 1)
        .otherwise(True)
    )
    kept = F.when(platform == "linkedin", F.slice(parts, 1, 2)).when((platform == "youtube") & first.startswith("@"), F.slice(parts, 1, 1)).when(platform == "youtube", F.slice(parts, 1, 2)).otherwise(parts)
    names = hosts or {h: p for p, h in {p: h for h, p in reversed(PLATFORMS.items())}.items()}
    home = F.lit(None).cast("string")
    for h, name in names.items():
        home = F.when(platform == name, h).otherwise(home)
    url = F.concat(F.lit("https://"), home, F.lit("/"), F.array_join(kept, "/"))
    return F.when(platform.isNotNull() & (n > 0) & ~no_page & right, F.struct(platform.alias("platform"), url.alias("url")))


def job_board(c: Column, boards: tuple[str, ...] = JOB_BOARDS) -> Column:
    """The address without fragment where it opens one employer's board on a recruiting system; null otherwise.

    The system's own pages do not count unless the path names an employer or a posting; on
    hosts that employers share the path or the query has to name one.
    """
    own, p = host(c), F.lower(path(c))
    hit, sub = F.lit(None).cast("string"), F.lit(None).cast("string")
    for b in boards:
        below = own.endswith("." + b)
        sub = F.when(own == b, "").when(below, F.regexp_replace(own, "\\." + b.replace(".", "\\.") + "$", "")).otherwise(sub)
        hit = F.when((own == b) | below, b).otherwise(hit)
    query = F.contains(c, F.lit("?"))
    tenant = (
        F.when(hit == "linkedin.com", p.startswith("/company/") & F.contains(p, F.lit("/jobs")))
        .when(hit == "finn.no", p.startswith("/job/") & (query | (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) > 2)))
        .when(hit == "nav.no", sub.endswith("arbeidsplassen") & p.rlike("^/(stillinger|stilling)/"))
        .when(sub.isin("", "cdn", "static", "assets", "media", "img", "images", "help", "support", "blog"), p.rlike("[0-9]{3,}|/(arbeidsgiver|employers?|bedrift|company|companies|stilling|job)s?/"))
        .when(sub.isin("boards", "job-boards", "jobs", "apply", "candidate", "careers") | sub.rlike("^career[0-9]*$"), (F.regexp_replace(p, "/", "") != "") | query)
        .otherwise(True)
    )
    page = ~p.rlike("\\.(js|css|png|jpe?g|svg|gif|webp|ico)$") & F.lower(F.trim(c)).rlike("^https?://")
    return F.when(hit.isNotNull() & tenant & page, F.regexp_replace(F.trim(c), "#.*$", ""))


def resolved(base: Column, href: Column) -> Column:
    """An address in a page as a whole one: as it is, below the host, or beside the page; null for mail, telephone, script and fragment."""
    link = F.trim(href)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(://[^/]+.*/)[^/]*$", "$1")
    return (
        F.when((link == "") | link.rlike("^(?i)(#|javascript:|mailto:|tel:)"), None)
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder.rlike("://[^/]+/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )
