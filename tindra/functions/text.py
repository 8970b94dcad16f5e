"""Text as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a name that tell its legal form or nothing.
LEGAL_WORDS = ("as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen", "nuf", "ab", "b", "v", "limited", "ltd", "inc", "plc", "the", "og", "and")
_MARKED = "åøäöüéèêëáàâãíìîïóòôõúùûñçčšžðđł"
_PLAIN = "aoaoueeeeaaaaiiiioooouuunccszddl"


def folded(c: Column) -> Column:
    """Small letters without marks; æ becomes ae."""
    return F.translate(F.replace(F.lower(c), F.lit("æ"), F.lit("ae")), _MARKED, _PLAIN)


def tokens(c: Column, legal_words: bool = False) -> Column:
    """Words of a name in order: folded, of two characters or more, without legal forms unless asked for."""
    words = F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    keep = (lambda w: F.length(w) > 1) if legal_words else (lambda w: (F.length(w) > 1) & ~w.isin(*LEGAL_WORDS))
    return F.filter(words, keep)


def compact(c: Column) -> Column:
    """Letters and digits only, folded."""
    return F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def filled(c: Column) -> Column:
    """Null for the empty text: an empty field counts as absent."""
    return F.when(F.trim(c) != "", c)


def number(c: Column) -> Column:
    """A whole number or null."""
    return F.regexp_extract(F.trim(c.cast("string")), r"^([0-9]{1,9})$", 1).try_cast("int")


def overlap(a: Column, b: Column) -> Column:
    """How many distinct words two arrays share."""
    return F.size(F.array_intersect(a, b))


def clean_title(c: Column, limit: int = 300) -> Column:
    """One line, single spaces, without a trailing site name or read-more label, cut at ``limit``; empty gives null."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    one = F.regexp_replace(one, r"(?i)( - les mer| » kontakt oss)$", "")
    one = F.regexp_replace(one, r" [|»] [^|»]*$", "")
    return filled(F.substring(F.trim(one), 1, limit))


def has_phrase(words: Column, phrase: Column) -> Column:
    """Whether an array of words holds the words of another in a row; an empty phrase is nowhere."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.size(phrase) + 1, F.lit(1)))
    return (F.size(phrase) > 0) & F.exists(starts, lambda k: F.slice(words, k, F.size(phrase)) == phrase)


def first_rule(rules: list[tuple[str, str]], *texts: Column) -> Column:
    """The name of the first rule whose pattern occurs in the texts, letter case ignored; null where none does."""
    text = F.concat_ws(" ", *texts)
    result = None
    for name, pattern in rules:
        hit = text.rlike("(?iu)" + pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


# Titles that name a section rather than a posting or an article, and what stands before or after a headline.
CAREER_TITLES = (
    "karriere", "stillinger", "jobb", "jobs", "career", "careers", "ledige stillinger", "jobb hos oss", "bli med på laget", "bli vår kollega", "rekruttering", "arbeidsplassen",
    "åpen søknad", "open application", "work with us", "join our team", "vacancies", "open positions", "see our open positions", "see our open positions and jobs worldwide",
    "open positions and jobs worldwide", "our open positions", "ledige stillinger og jobber", "se våre ledige stillinger", "se alle ledige stillinger", "view all open positions",
    "search all jobs", "search open positions", "view open jobs",
)
SECTION_TITLES = (
    "nyheter", "aktuelt", "presse", "news", "press", "artikler", "blogg", "blog", "pressemeldinger", "arkiv", "newsroom", "events", "arrangementer", "kurs",
    "hjem", "forside", "home", "om oss", "about us", "kontakt oss", "contact us",
)
_MONTH_NAMES = "januar|january|jan|februar|february|feb|mars|march|mar|april|apr|mai|may|juni|june|jun|juli|july|jul|august|aug|september|sept|sep|oktober|october|okt|oct|november|nov|desember|december|des|dec"
#: In order: what is taken off a headline.
HEADLINE_CUTS = (
    f"^((publisert|oppdatert|published|updated|dato|date)[ ]*:?[ ]*)?([0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[.]?[ ]+({_MONTH_NAMES})[.]?[ ]+[0-9]{{4}})(,?[ ]*(kl[.]?[ ]*)?[0-9]{{1,2}}[:.][0-9]{{2}})?[ ]*[|·•–—-]?[ ]*",
    "^(kl[.]?[ ]*)?[0-9]{1,2}[:.][0-9]{2}[ ]*([(](cest|cet|utc|gmt|bst)[)]|cest|cet|utc|gmt)?[ ]*[|·•–—-]?[ ]+",
    "^[ ]*[|]?[ ]*regulatory information[ ]*",
    "^(nyheter|nyhet|news|aktuelt|pressemelding|press release|blogg|blog|artikkel)[ ]*[|·:–—-]?[ ]+",
    "[ ]*[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}[ ]*[-–]?[ ]*(publisert|oppdatert|published).*$",
    "[ ]*[-–|][ ]*(publisert|published) av .*$",
    "^[-–—•*|:/]+[ ]*",
    "[ ]*[-–—•*|:]+$",
)
#: In order: kinds of activities and what tells them.
ACTIVITY_KINDS = (
    ("press_release", "pressemelding|press release|børsmelding"),
    ("partnership", "samarbeid|partner|allianse|avtale"),
    ("launch", "lanserer|lansering|launch|nytt produkt|ny tjeneste|introduserer"),
    ("award", "vinner|vant|kåret|award|akkreditering|sertifisering|(^|[^0-9a-zæøå_])(pris|prisen|priser)([^0-9a-zæøå_]|$)"),
    ("event", "webinar|konferanse|seminar|event|messe|arrangement|frokostmøte"),
    ("announcement", "kunngjøring|announcement|endring|varsel|informasjon til"),
    ("news", "nyhet|siste nytt|aktuelt|artikkel"),
)


def posting_title(c: Column, limit: int = 200) -> Column:
    """A posting's title in one line without strokes and dots around it; null for less than three characters and for titles of sections."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(one, "^[-–—•*|:]+[ ]*", ""), "[ ]*[-–—•*|:]+$", ""))
    return F.when((F.length(bare) >= 3) & ~F.lower(bare).isin(*CAREER_TITLES), F.substring(bare, 1, limit))


def headline(c: Column, limit: int = 300) -> Column:
    """An article's headline in one line without dates, section names and bylines around it; null for less than four characters and for names of sections."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    for cut in HEADLINE_CUTS:
        one = F.regexp_replace(one, "(?iu)" + cut, "")
    bare = F.trim(one)
    return F.when((F.length(bare) >= 4) & ~F.lower(bare).isin(*SECTION_TITLES), F.substring(bare, 1, limit))


def activity_kind(title: Column, body: Column) -> Column:
    """The kind of an activity by the first rule that its title or the text holds; company_update for none."""
    said = F.lower(F.concat_ws(" ", title, body))
    kind = F.lit("company_update")
    for name, pattern in reversed(ACTIVITY_KINDS):
        kind = F.when(said.rlike(pattern), name).otherwise(kind)
    return kind
