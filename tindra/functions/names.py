"""Names of companies against sites and accounts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tindra.functions.text import compact, folded, tokens
from tindra.functions.urls import host, segments

# Endings of names that tell a legal form, public suffixes of two labels, hosts of site builders and platforms, words of branches, what may follow a name in an account.
LEGAL_ENDINGS = (
    "as", "asa", "ans", "da", "enk", "nuf", "sa", "iks", "ks", "ba", "sf", "hf", "bbl", "brl", "esek", "fli", "sti",
    "aksjeselskap", "allmennaksjeselskap", "borettslag", "boligbyggelag", "enkeltpersonforetak", "stiftelse", "forening", "sameie",
)
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.nz", "co.jp", "kommune.no", "fylkeskommune.no", "herad.no", "priv.no", "stat.no")
HOSTING = (
    "wix", "wixsite", "squarespace", "webflow", "weebly", "jimdo", "jimdofree", "blogspot", "wordpress",
    "github", "netlify", "vercel", "google", "sites", "framer", "godaddysites", "mystrikingly", "strikingly",
    "hubspot", "shopify", "myshopify", "facebook", "instagram", "linkedin", "youtube", "tiktok", "twitter",
)
BRANCHES = (
    "ost", "vest", "nord", "sor", "midt", "indre", "ytre", "ostre", "vestre", "nordre", "sondre", "region",
    "avdeling", "avd", "lokallag", "lag", "krets", "distrikt", "fylkeslag", "fylke", "kommune",
    "ostfold", "akershus", "buskerud", "vestfold", "telemark", "agder", "rogaland", "hordaland", "vestland",
    "sogn", "fjordane", "more", "romsdal", "trondelag", "nordland", "troms", "finnmark", "innlandet",
    "hedmark", "oppland", "viken", "oslo", "bergen", "trondheim", "stavanger",
)
PLATFORM_ACCOUNTS = (*HOSTING, "envato", "themeforest", "elementor", "mailchimp", "home", "share", "sharer", "username", "yourpage", "page")
AFTER_NAME = ("", "no", "norge", "norway", "as", "asa", "sa", "official", "offisiell", "hq", "group", "gruppen", "com", "dk", "se")
ACCOUNT_PREFIXES = ("company", "school", "showcase", "channel", "user", "c", "pg")


def full_words(name: Column) -> Column:
    """All words of a name but its legal form, single characters and digits too; ``a s`` at an end is a legal form."""
    words = F.regexp_extract_all(folded(F.replace(F.coalesce(name, F.lit("")), F.lit("&"), F.lit(" "))), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_ENDINGS))
    form = F.array(F.lit("a"), F.lit("s"))
    kept = F.when((F.size(kept) >= 2) & (F.slice(kept, F.size(kept) - F.least(F.size(kept), F.lit(2)) + 1, 2) == form), F.slice(kept, 1, F.greatest(F.size(kept) - 2, F.lit(0)))).otherwise(kept)
    return F.when((F.size(kept) >= 2) & (F.slice(kept, 1, 2) == form), F.slice(kept, 3, F.size(kept))).otherwise(kept)


def registered_domain(url: Column) -> Column:
    """The host without the labels before its registered name; null where there is no host of two labels."""
    labels = F.split(host(url), r"\.")
    size = F.when(host(url).rlike("(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in LONG_SUFFIXES) + ")$"), 3).otherwise(2)
    return F.when(F.size(labels) >= size, F.array_join(F.slice(labels, F.size(labels) - size + 1, size), "."))


def site_root(url: Column) -> Column:
    """The name in a site's registered domain; empty for names of less than three characters and for hosts of site builders."""
    root = F.regexp_replace(F.coalesce(F.substring_index(registered_domain(url), ".", 1), F.lit("")), "[^a-z0-9]", "")
    return F.when((F.length(root) < 3) | root.isin(*HOSTING), "").otherwise(root)


def spelled_by_site(name: Column, root: Column) -> Column:
    """(spelled, rest): the words of a name that together make up the site's name, and the others; æ may be written ae or a."""

    def reading(c: Column) -> Column:
        words = tokens(c)
        spelled = F.filter(words, lambda w: F.contains(root, w))
        return F.when((root != "") & (F.array_join(spelled, "") == root), F.struct(spelled.alias("spelled"), F.filter(words, lambda w: ~F.contains(root, w)).alias("rest")))

    none = F.struct(F.array().cast("array<string>").alias("spelled"), tokens(name).alias("rest"))
    return F.coalesce(reading(name), reading(F.translate(name, "æÆ", "aA")), none)


def specific_words(name: Column, root: Column) -> Column:
    """The words of a name that its site's name does not hold."""
    return F.filter(tokens(name), lambda w: ~F.contains(root, w))


def is_branch(name: Column, root: Column, *places: Column) -> Column:
    """Whether a company is a local branch of whom the site belongs to: the site spells words of its name, and another is a place or a word for branches."""
    words = F.array_union(F.array(*(F.lit(w) for w in BRANCHES)), tokens(F.concat_ws(" ", *places)))
    said = spelled_by_site(name, root)
    return (F.size(said["spelled"]) > 0) & F.exists(said["rest"], lambda w: F.array_contains(words, w))


def account(url: Column) -> Column:
    """The account in a profile's address, letters and digits only; empty where only a number stands for it."""
    own = segments(url)
    first = F.when(F.get(own, F.lit(0)).isin(*ACCOUNT_PREFIXES), F.get(own, F.lit(1))).otherwise(F.get(own, F.lit(0)))
    return F.when(first.isNull() | first.rlike(r"^[0-9]+$|^uc[a-z0-9_-]{20,}$"), "").otherwise(compact(F.regexp_replace(first, "^@+", "")))


def account_is_site(handle: Column, root: Column) -> Column:
    """Whether an account is the site's own name, with a common ending or, of a long name, with little around it."""
    rest = F.substring(handle, F.length(root) + 1, F.length(handle))
    close = F.startswith(handle, root) & rest.isin(*AFTER_NAME)
    around = (F.length(root) >= 6) & F.contains(handle, root) & (F.length(handle) - F.length(root) <= 12)
    return (root != "") & (handle != "") & ~handle.isin(*PLATFORM_ACCOUNTS) & (close | around)
