"""What a page says about whose it is, and how far that fits a company.

Works on single records and knows no Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from tindra.llm.address_parts import Towns, distance, fold

# Legal forms, words before or in page titles that name nobody, words that make another entity of a name, titles of empty sites and of lists.
LEGAL_FORMS = {"as": "as", "a/s": "as", "asa": "asa", "da": "da", "ans": "ans", "sa": "sa", "nuf": "nuf", "enk": "enk", "ks": "ks", "stiftelse": "sti", "borettslag": "brl"}
REGIONS = ("nord", "sor", "ost", "vest")
GENERIC = ("om", "oss", "hjem", "forside", "kontakt", "velkommen", "til", "i", "in", "pa", "ved", "og", "co", "av", "din", "lokale", "leverandor", "du", "kan", "stole", "bedrifter", "er", "the", "of")
RELATED = ("holding", "invest", "pensjonskasse", "idrettslag", "utleie", "stiftelsen")
PARKED = ("domenet er til salgs", "index of /", "kommer snart", "this domain is parked", "nettsiden er under oppussing")
LISTING = re.compile(r"^bedrifter i\b|[?&]q=")
_WORD = re.compile(r"[a-z]+")


def plain(text: str | None) -> str:
    return fold(text or "")


@dataclass(frozen=True)
class Company:
    stem: str
    region: str
    trade: str
    legal: str
    municipalities: frozenset[str]


def municipalities_of(text: str | None, towns: Towns) -> frozenset[str]:
    """The municipalities that a place name, with at most one typing error, can mean."""
    name = plain(text).strip()
    if not name:
        return frozenset()
    if name not in towns.by_municipality and not (name := towns.named(name) or near_municipality(name, towns)):
        return frozenset()
    found = {m for m, inside in towns.by_municipality.items() if name in inside}
    return frozenset(found | ({name} if name in towns.by_municipality else set()))


def near_municipality(name: str, towns: Towns) -> str:
    near = [m for m in towns.by_municipality if abs(len(m) - len(name)) <= 1 and distance(m, name, 1) <= 1]
    return near[0] if len(near) == 1 else ""


def name_words(name: str | None) -> tuple[list[str], str]:
    """The words of a company's name without its legal form, and that form."""
    words = re.findall(r"[a-z]+(?:/[a-z]+)?", plain(name))
    legal = ""
    for at in (-1, 0):
        if len(words) > 1 and words[at] in LEGAL_FORMS:
            legal = LEGAL_FORMS[words.pop(at)]
            break
    return [w for w in words if w not in ("co", "og")], legal


def company(name: str | None, municipality: str | None, towns: Towns, trades: frozenset[str] = frozenset()) -> Company | None:
    """A company's name taken apart: stem, region word, trade word, legal form.

    ``trades`` are words that tell a trade (see ``entities.trades_of_names``).  The stem is the
    first word that is none of them nor a region, wherever it stands; the trade is the
    last of the other words, a known one before others.
    """
    words, legal = name_words(name)
    if not words:
        return None
    own = [w for w in words if w not in trades and w not in REGIONS]
    stem = own[0] if own else words[0]
    rest = list(words)
    rest.remove(stem)
    region = next((w for w in rest if w in REGIONS), "")
    other = [w for w in rest if w not in REGIONS]
    known = [w for w in other if w in trades]
    return Company(stem, region, (known or other or [""])[-1], legal, municipalities_of(municipality, towns) if municipality else frozenset())


@dataclass(frozen=True)
class Page:
    kind: str  # "", "related", "parked" or "listing"
    words: tuple[str, ...]  # of the title that may name somebody
    labels: tuple[str, ...]  # of the url that may name somebody, without punctuation
    region: str
    legal: str
    places: frozenset[str]


def page(url: str | None, title: str | None, place: str | None, towns: Towns) -> Page:
    """What a page says.  Its owner may stand in the first label of the host or in the last segment of the path (a page on a portal); both are read."""
    text = plain(title).strip()
    address = re.sub(r"^[a-z]+://", "", unquote(url or "").lower())
    host, _, path = address.partition("/")
    host = re.sub(r"^www\d?\.", "", host)
    segments = [s for s in re.sub(r"[?#].*", "", path).split("/") if s]
    slugs = [host.partition(".")[0], *segments[-1:]]
    parts = [_WORD.findall(plain(s)) for s in slugs]
    labels = tuple(dict.fromkeys(label for words in parts if (label := "".join(words))))
    words = tuple(w for w in _WORD.findall(text) if w not in GENERIC and len(w) > 1)
    kind = ""
    if any(text == p or text.startswith(p) for p in PARKED):
        kind = "parked"
    elif LISTING.search(text) or LISTING.search(address):
        kind = "listing"
    elif any(w in RELATED for w in (*words, *(w for own in parts for w in own))):
        kind = "related"
    region = next((w for w in words if w in REGIONS), "")
    legal = next((LEGAL_FORMS[w] for w in re.findall(r"[a-z]+(?:/[a-z]+)?", text)[1:] if w in LEGAL_FORMS), "")
    places = municipalities_of(place, towns) if place else frozenset()
    if not places:
        said = re.search(r"\b(?:i|in|pa|ved) ([a-z]+)\s*$", text)
        for hint in ([said[1]] if said else []) + segments[:-1] + [w for own in parts for w in own[1:]]:
            if places := municipalities_of(hint, towns):
                break
    return Page(kind, words, labels, region, legal, places)


def shortened(c: Company) -> set[str]:
    """Beginnings of the stem with the beginning of the trade."""
    return {c.stem[:n] + c.trade[:3] for n in range(3, 7) if n < len(c.stem)} if len(c.trade) > 2 else set()
