"""Tables out of pages, sitemaps, feeds and embedded data, by built-in functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions.days import day_in_address, day_of
from tindra.functions.urls import JOB_BOARDS, blocked, canonical, host, is_article, is_posting, job_board, news_section, path, resolved, segments
from tindra.operators.ranking import round_robin

_CDATA = r"<!\[CDATA\[(.*?)\]\]>"


def _text(c: Column) -> Column:
    """Text of an element: CDATA opened, tags dropped, the five named characters put back."""
    plain = F.regexp_replace(F.regexp_replace(c, "(?s)" + _CDATA, "$1"), "(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")  # no-break spaces around it count as space


def _element(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1)
    return F.when(found != "", _text(found))


def title_of(html: Column) -> Column:
    """The text of a page's title element."""
    return _element(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "title")


def html_facts(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, headline, links): what a page says of itself; scripts and styles do not count."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    hrefs = F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1)), lambda x: x != ""))
    return df.where(F.col(html).isNotNull()).select(key, _element(body, "title").alias("title"), _element(body, "h1").alias("headline"), F.size(hrefs).alias("links"))


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, href, text) of the links of each page, in order."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    rows = df.where(F.col(html).isNotNull()).select(key, F.posexplode(anchors).alias("place", "a"))
    return rows.select(key, "place", F.regexp_extract("a", r"""(?i)href\s*=\s*["']([^"']*)""", 1).alias("href"), _text(F.col("a")).alias("text"))


def sitemap(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, place, loc, lastmod) of the entries of sitemaps; entries without address are left out."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url>"), F.lit(1))
    rows = df.where(F.col(xml).isNotNull()).select(key, F.posexplode(blocks).alias("place", "b"))
    return rows.select(key, "place", _element(F.col("b"), "loc").alias("loc"), _element(F.col("b"), "lastmod").alias("lastmod")).where("loc is not null")


def feed(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, place, title, link, published) of the items of RSS and Atom feeds."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<((?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))
    rows = df.where(F.col(xml).isNotNull()).select(key, F.posexplode(blocks).alias("place", "b"))
    b = F.col("b")
    href = F.regexp_extract(b, r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)""", 1)
    link = F.coalesce(_element(b, "link"), F.when(href != "", href))
    published = F.coalesce(_element(b, "pubDate"), _element(b, "published"), _element(b, "updated"))
    return rows.select(key, "place", _element(b, "title").alias("title"), link.alias("link"), published.alias("published"))


def json_ld(df: DataFrame, key: str, html: str, *kinds: str) -> DataFrame:
    """(key, place, item): the objects of the given ``@type`` in a page's embedded data, at any depth, in their order; items are JSON texts.

    ``@type`` may be a list.  An object found is searched for further ones inside it.
    Data that is no JSON is skipped.  Depth is free, which no built-in function has, so
    pages with such data go through Python in batches.
    """
    import json

    wanted = frozenset(kinds)

    @F.pandas_udf("array<string>")
    def nodes(scripts: pd.Series) -> pd.Series:
        def found(script: str) -> list[str]:
            try:
                stack, out = [json.loads(script)], []
            except (ValueError, RecursionError):
                return []
            while stack:
                x = stack.pop()
                if isinstance(x, dict):
                    own = x.get("@type")
                    if wanted & {t for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)}:
                        out.append(json.dumps(x, ensure_ascii=False, sort_keys=True))
                    stack.extend(reversed(x.values()))
                elif isinstance(x, list):
                    stack.extend(reversed(x))
            return out

        return pd.Series([[item for script in own for item in found(script)] for own in scripts], dtype=object)

    scripts = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    rows = df.where(F.contains(F.lower(F.col(html)), F.lit("ld+json"))).select(key, scripts.alias("_s"))
    return rows.select(key, F.posexplode(nodes("_s")).alias("place", "item"))


def postings(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, title, location, employment_type, employer, published_at, deadline, url) of the job postings in a page's embedded data."""
    item = F.col("item")
    get = lambda *paths: F.coalesce(*(F.get_json_object(item, p) for p in paths))
    return json_ld(df, key, html, "JobPosting").select(
        key, "place", get("$.title", "$.name").alias("title"), get("$.jobLocation.address.addressLocality", "$.jobLocation[0].address.addressLocality", "$.jobLocation.name").alias("location"),
        get("$.employmentType").alias("employment_type"), get("$.hiringOrganization.name", "$.hiringOrganization").alias("employer"),
        get("$.datePosted").alias("published_at"), get("$.validThrough").alias("deadline"), get("$.url").alias("url"),
    ).where("title is not null")


ARTICLES = ("Article", "NewsArticle", "BlogPosting", "Report", "Event")


def articles(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, kind, title, day, url) of the articles and events in a page's embedded data."""
    item = F.col("item")
    get = lambda *paths: F.coalesce(*(F.get_json_object(item, p) for p in paths))
    kind = F.coalesce(*(F.when((F.get_json_object(item, "$.@type") == a) | F.contains(F.get_json_object(item, "$.@type"), F.lit(f'"{a}"')), a) for a in ARTICLES))
    return json_ld(df, key, html, *ARTICLES).select(key, "place", kind.alias("kind"), get("$.headline", "$.name").alias("title"), day_of(get("$.datePublished", "$.startDate")).alias("day"), get("$.url", "$.mainEntityOfPage.@id", "$.mainEntityOfPage").alias("url")).where("title is not null")


def organisations(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, name, url, same_as): organisations that a page's embedded data name, with their other addresses."""
    item = F.col("item")
    listed = F.coalesce(F.from_json(F.get_json_object(item, "$.sameAs"), "array<string>"), F.array(F.get_json_object(item, "$.sameAs")))
    return json_ld(df, key, html, "Organization", "Corporation", "LocalBusiness").select(key, "place", F.get_json_object(item, "$.name").alias("name"), F.get_json_object(item, "$.url").alias("url"), F.array_compact(listed).alias("same_as"))


# Link texts that name nothing.
LINK_TEXTS = ("les mer", "read more", "les hele saken", "se alle", "se mer", "mer", "more", "vis alle", "flere nyheter", "flere prosjekter", "alle nyheter", "all news", "neste", "forrige")
_CUT = r"(?is)<(script|style)\b.*?</\1>"


def page_links(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, place, url, text): the links of each page as whole addresses, in order; an address counts once, where it first stands."""
    rows = links(df.select(key, url, html), key, html).join(df.select(F.col(key).alias("_k"), F.col(url).alias("_base")).distinct(), F.col(key) == F.col("_k"))
    whole = rows.withColumn("url", resolved(F.col("_base"), F.col("href"))).withColumn("_u", canonical(F.col("url"))).where("_u is not null")
    first = whole.groupBy(key, "_u").agg(F.min_by(F.struct("place", "url", "text"), "place").alias("_r"))
    return first.select(key, "_r.*")


def article_links(links_of_pages: DataFrame, key: str, url: str, text: str, site: str, least: int = 15) -> DataFrame:
    """The links that name an article of the site: on its host, with a title of ``least`` characters or more that is no link text."""
    title = F.trim(F.col(text))
    own = (host(F.col(url)) == host(F.col(site))) & (F.length(title) >= least) & ~F.lower(title).isin(*LINK_TEXTS)
    return links_of_pages.where(F.coalesce(own, F.lit(False)))


def posting_links(links_of_pages: DataFrame, url: str) -> DataFrame:
    """The links that open one posting or one employer's board."""
    return links_of_pages.where(is_posting(F.col(url)) | job_board(F.col(url)).isNotNull())


# Kinds of pages that are worth reading, the words for them, and how many of each come before others.
PRIORITIES = (
    ("careers", ("karriere", "stillinger", "ledige-stillinger", "jobb", "jobs", "career", "vacancies", "rekruttering", "bli-med-pa-laget", "jobb-hos-oss", "work-with-us", "join-us"), 2),
    ("news", ("nyheter", "nyhet", "aktuelt", "news", "presse", "press", "pressemeldinger", "artikler", "blogg", "blog", "nyhetsrom", "newsroom", "pressroom", "media", "kunngjoringer", "announcements"), 2),
    ("about", ("om-oss", "om_oss", "about", "ledelse", "management", "team", "people"), 2),
    ("contact", ("kontakt", "contact"), 1),
    ("investors", ("investors", "investor", "investorer"), 1),
    ("locations", ("locations", "lokasjoner", "avdelinger", "butikker"), 1),
    ("events", ("events", "arrangementer"), 1),
)
NO_PAGE = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3)$"


def priority_links(links_of_pages: DataFrame, key: str, url: str, text: str, site: str, n: int = 8) -> DataFrame:
    """(key, url, kind, place): the ``n`` links of each page to read next.

    Only pages on the site's host, not the page itself.  A link's kind is the first
    whose word its path or its text holds; a word in the path counts more than one in
    the text, a short path more than a long one.  Kinds take turns up to their share,
    then the others follow in order.
    """
    p, said = F.lower(path(F.col(url))), F.lower(F.col(text))
    kind, in_path, number, quota = F.lit(None).cast("string"), F.lit(False), F.lit(99), F.lit(0)
    for k, (name, words, share) in reversed(list(enumerate(PRIORITIES))):
        there = p.rlike("|".join(w.replace("-", "[-]") for w in words))
        hit = there | said.rlike("|".join(w.replace("-", " ").replace("_", " ") for w in words))
        kind, in_path, number, quota = F.when(hit, name).otherwise(kind), F.when(hit, there).otherwise(in_path), F.when(hit, k).otherwise(number), F.when(hit, share).otherwise(quota)
    own = (host(F.col(url)) == host(F.col(site))) & (canonical(F.col(url)) != canonical(F.col(site))) & ~p.rlike(NO_PAGE) & ~F.contains(p, F.lit("nyhetsbrev")) & ~F.contains(p, F.lit("newsletter"))
    rows = links_of_pages.where(F.coalesce(own, F.lit(False))).select(key, canonical(F.col(url)).alias("url"), kind.alias("kind"), number.alias("_k"), quota.alias("_q"), F.when(in_path, 0).otherwise(1).alias("_p"), F.size(segments(F.col(url))).alias("_d"), F.length(p).alias("_l"))
    best = rows.where("kind is not null").groupBy(key, "url").agg(F.min(F.struct("_k", "_p", "_d", "_l", "kind", "_q")).alias("_r")).select(key, "url", "_r.*")
    order = [F.col(c) for c in ("_p", "_d", "_l", "url")]
    ranked = best.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "kind").orderBy(*order))).where(F.col("_rn") <= n)
    over = F.when(F.col("_rn") <= F.col("_q"), 0).otherwise(1)
    turn = Window.partitionBy(key).orderBy(over, F.when(over == 0, F.col("_rn")).otherwise(0), "_k", *order)
    return ranked.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= n).select(key, "url", "kind", "place")


def selected_articles(entries: DataFrame, key: str, url: str, day: str, n: int = 8) -> DataFrame:
    """(key, url, day, place): the articles of a site's entries to read: no address with others below it, the best dated of each slug, sections in turns.

    The day in the address counts before the entry's; sections come by their newest
    article, then by name.
    """
    rows = entries.where(F.col(key).isNotNull()).select(key, F.col(url).alias("url"), F.array_join(segments(F.col(url)), "/").alias("_p"), segments(F.col(url)).alias("_s"), F.coalesce(day_in_address(path(F.col(url))), F.col(day), F.lit("")).alias("day"))
    parents = rows.select(F.col(key).alias("_k"), F.explode(F.when(F.size("_s") > 1, F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda k: F.array_join(F.slice("_s", 1, k), "/")))).alias("_a")).distinct()
    leaves = rows.where(is_article(F.col("url"))).join(parents, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_a")), "left_anti").withColumn("_slug", F.try_element_at("_s", F.lit(-1)))
    best = leaves.groupBy(key, "_slug").agg(F.min_by(F.struct("url", "day"), F.struct(F.translate("day", "0123456789", "9876543210").alias("d"), F.length("day") == 0, F.col("url"))).alias("_r")).select(key, "_r.*")
    return round_robin(best.withColumn("section", news_section(F.col("url"))), key, "section", [F.desc("day"), F.col("url")], "day", n).select(key, "url", "day", "place")


# Words of a text that only a posting has.
POSTING_WORDS = (
    "søknadsfrist|søk på stillingen|søk stillingen|søk nå|apply now|apply for|application deadline|stillingsprosent|fast stilling|fast ansettelse|vikariat|engasjement|"
    "heltid|deltid|full[- ]time|part[- ]time|tiltredelse|arbeidssted|stillingstittel|job id|stillings-?id"
)


def posting_signs(url: Column, text: Column, deadline: Column, is_card: Column) -> Column:
    """The signs that a link is one posting, in order: deadline, posting_terms, ats_listing, card_element."""
    signs = (("deadline", F.coalesce(deadline != "", F.lit(False))), ("posting_terms", F.coalesce(text.rlike("(?iu)" + POSTING_WORDS), F.lit(False))), ("ats_listing", blocked(url, list(JOB_BOARDS))), ("card_element", F.coalesce(is_card, F.lit(False))))
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in signs)))


def page_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, footer, meta): what a page shows, without tags; its footer; and the names and titles that its metadata tell."""
    body = F.regexp_replace(F.col(html), _CUT, " ")
    meta = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<meta\b[^>]*(?:og:site_name|og:title|application-name|author)["'][^>]*content\s*=\s*["']([^"']*)"""), F.lit(1))
    return df.where(F.col(html).isNotNull()).select(key, _text(F.regexp_replace(body, r"(?is)<title\b.*?</title>", " ")).alias("text"), _element(body, "footer").alias("footer"), F.array_join(meta, " ").alias("meta"))


def decompressed(body: Column, limit: int = 8_000_000) -> Column:
    """A body as it was before gzip or deflate, at most ``limit`` bytes and one; what came of a broken stream is kept, other bodies stay."""

    @F.pandas_udf("binary")
    def opened(bodies: pd.Series) -> pd.Series:
        import zlib

        def one(b):
            if b is None:
                return None
            b = bytes(b)
            if b[:2] != b"\x1f\x8b" and b[:1] != b"\x78":
                return b[: limit + 1]
            try:
                return zlib.decompressobj(47).decompress(b, limit + 1)
            except zlib.error:
                pass
            reader, out = zlib.decompressobj(47), b""
            for k in range(0, len(b), 512):  # up to where the stream breaks
                try:
                    out += reader.decompress(b[k : k + 512], limit + 1 - len(out))
                except zlib.error:
                    break
                if len(out) > limit:
                    break
            return out or b[: limit + 1]

        return pd.Series([one(b) for b in bodies], dtype=object)

    return opened(body)


def decoded(body: Column, charset: Column) -> Column:
    """Bytes as text in the charset that was declared; one that is unknown or missing is UTF-8, or Latin-1 where that does not fit."""
    name = F.upper(F.trim(F.coalesce(charset, F.lit(""))))
    latin = F.decode(body, "ISO-8859-1")
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(latin)
    return F.when(name.isin("ISO-8859-1", "LATIN-1", "LATIN1", "WINDOWS-1252", "CP1252"), latin).when(name == "UTF-16", F.decode(body, "UTF-16")).otherwise(utf8)


def is_json(c: Column) -> Column:
    """Whether a text is a JSON object or list."""
    return F.coalesce(F.get_json_object(c, "$").isNotNull() & F.trim(c).rlike(r"^[\[{]"), F.lit(False))


def json_fields(df: DataFrame, body: str, fields: dict[str, str]) -> DataFrame:
    """Adds columns from JSON bodies by path; null where the body is no JSON."""
    return df.withColumns({name: F.get_json_object(F.col(body), path) for name, path in fields.items()})


def publication_day(html: Column, url: Column) -> Column:
    """The day a page was published, as YYYY-MM-DD: told by its metadata, its embedded data, a time element, its address, or the one date in it."""
    iso = r"(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))"
    one = lambda pattern: F.regexp_extract(html, pattern, 1)
    meta = one(r"""(?is)<meta\b[^>]*(?:article:published_time|datePublished|pubdate)["'][^>]*content\s*=\s*["']""" + iso)
    data = one(r'"datePublished"\s*:\s*"' + iso)
    time = one(r"""(?is)<time\b[^>]*datetime\s*=\s*["']""" + iso)
    address = F.regexp_replace(F.regexp_extract(url, r"/(20\d{2}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01]))(?:[/-]|$)", 1), "/", "-")
    every = F.array_distinct(F.regexp_extract_all(html, F.lit(iso), F.lit(1)))
    only = F.when(F.size(every) == 1, every[0])
    empty = lambda c: F.when(c != "", c)
    return F.coalesce(empty(meta), empty(data), empty(time), empty(address), only)


def search_results(df: DataFrame, key: str, body: str, path: str = "$.web.results") -> DataFrame:
    """(key, rank, url, title, snippet) of the results of search answers in JSON; rank counts from 1."""
    items = F.from_json(F.get_json_object(F.col(body), path), "array<struct<url:string,title:string,description:string>>")
    rows = df.select(key, F.posexplode(items).alias("_p", "r"))
    return rows.select(key, (F.col("_p") + 1).alias("rank"), "r.url", "r.title", F.col("r.description").alias("snippet")).where("url is not null")
