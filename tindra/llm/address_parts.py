"""Reading of an address text into street, number, letter or box, and town.

Works on one text at a time and knows no Spark; the operator calls it once for each
distinct text of a batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kinds of streets with their spellings, and words before a street name.
STREET_KINDS = {
    "gate": ("gate", "gata", "gaten", "gt", "g", "gtn"),
    "vei": ("vei", "veg", "veien", "vegen", "v", "vn", "vg"),
    "plass": ("plass", "plassen", "pl", "pls"),
    "torg": ("torg", "torget", "torv", "torvet", "tg", "tv"),
    "alle": ("alle", "alleen", "al"),
    "sti": ("sti", "stien", "st"),
    "sving": ("sving", "svingen", "sv", "svg", "svn"),
    "bakke": ("bakke", "bakken", "bk", "bkn"),
}
QUALIFIERS = {
    "nedre": ("nedre", "ndre", "ned", "ndr", "n", "nd"),
    "nordre": ("nordre", "no", "nord", "ndr", "n", "nr", "ndre"),
    "ovre": ("ovre", "ov", "o", "ovr"),
    "ostre": ("ostre", "ostr", "o", "ost"),
    "sondre": ("sondre", "sdr", "s", "sondr", "so"),
    "vestre": ("vestre", "vestr", "v", "ve", "vre"),
    "gamle": ("gamle", "gl", "gml", "gaml"),
    "store": ("store", "st"),
    "lille": ("lille", "l"),
    "indre": ("indre", "i"),
    "ytre": ("ytre", "y"),
}
_KIND = {s: kind for kind, spellings in STREET_KINDS.items() for s in spellings}
_FULL = sorted((s for s in _KIND if len(s) > 2 and s not in ("gtn", "pls", "svg", "svn", "bkn")), key=len, reverse=True)
_SHORT = [s for s in _KIND if s not in _FULL]
_QUALIFIER: dict[str, tuple[str, ...]] = {}
for _name, _spellings in QUALIFIERS.items():
    for _s in _spellings:
        _QUALIFIER[_s] = (*_QUALIFIER.get(_s, ()), _name)

_FOLD = str.maketrans({"å": "a", "ø": "o", "æ": "a", "ä": "a", "ö": "o", "é": "e", "è": "e", "ü": "u", "\xa0": " "})
_BOX = re.compile(r"\b(?:postboks|post ?box|p\.? ?o\.? ?(?:box|boks)|p\.? ?b|boks|box)\b\.?,? *(?:nr\.?|no\.?)? *(\d{1,5})\b")
_NOISE = [
    re.compile(r"\bc ?/ ?o\b[^,\d]*(?:,|$)"),
    re.compile(r"\b(?:v/|attn?\b)[^,\d]*(?:,|$)"),
    re.compile(r"\b[hulk] ?\d{4}\b"),
    re.compile(r"\b\d{1,2}\.? ?(?:etg|etasje|etage|floor|et)\b\.?"),
    re.compile(r"\b(?:plan|etg|etasje|floor|oppgang|inngang)\b\.? ?\d{1,2}\b"),
    re.compile(r"\b(?:bygg|bygning|building|blokk|leil(?:ighet)?|rom|suite|kontor)\b\.? *(?:nr\.?)? *\w{1,3}\b"),
    re.compile(r"\b(?:norge|norway|noreg)\b"),
]
_CODE = re.compile(r"(?:\bn(?:o)?[- ]?)?(?<!\d)(\d{4})(?!\d)")
_HOUSE = re.compile(r"(?<![a-z\d])(\d{1,4}) *-? *([a-z])?(?![a-z\d])")
_WORD = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    """Small letters without marks; doubled spellings of å, æ and ø count as the plain letter."""
    text = text.lower().translate(_FOLD)
    return text.replace("aa", "a").replace("ae", "a").replace("oe", "o")


@dataclass(frozen=True)
class Parts:
    """A house or a box.

    ``qualifiers`` are what the word before the name may stand for, ``readings`` the
    ways to split the rest into name and kind of street (an abbreviation can be read
    in more than one way), ``towns`` is empty where no town is told.
    """

    kind: str  # "house" or "box"
    qualifiers: tuple[str, ...]
    readings: tuple[tuple[str, str], ...]
    number: int
    letter: str
    towns: tuple[str, ...]


class Towns:
    """The postal places: code to town, municipality to towns, and towns by folded name."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.by_code = {code: fold(town) for code, town, _ in rows if code and town}
        self.by_municipality: dict[str, set[str]] = {}
        for _, town, municipality in rows:
            if town and municipality:
                self.by_municipality.setdefault(fold(municipality), set()).add(fold(town))
        self.names = set(self.by_code.values())
        self._near: dict[str, str | None] = {}

    def named(self, text: str) -> str | None:
        """The town of that name, with at most one typing error in it."""
        text = fold(text).strip(" .,()-")
        if text in self.names:
            return text
        if not text:
            return None
        if text not in self._near:
            if len(self._near) > 100_000:
                self._near.clear()
            near = [n for n in self.names if abs(len(n) - len(text)) <= 1 and distance(n, text, 1) <= 1]
            self._near[text] = near[0] if len(near) == 1 else None
        return self._near[text]


def distance(a: str, b: str, limit: int) -> int:
    """Edits with neighbouring letters swapped as one; ``limit + 1`` where there are more than ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
    return row[-1]


def street(words: list[str]) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """(qualifiers, readings) of the words of a street."""
    qualifiers: tuple[str, ...] = ()
    if len(words) > 1 and words[0] in _QUALIFIER and not (len(words) == 2 and words[1] in _KIND):
        qualifiers, words = _QUALIFIER[words[0]], words[1:]
    if len(words) > 1 and words[-1] in _KIND:
        return qualifiers, (("".join(words[:-1]), _KIND[words[-1]]),)
    name = "".join(words)
    for ending in _FULL:
        if len(name) > len(ending) + 2 and name.endswith(ending):
            return qualifiers, ((name[: -len(ending)], _KIND[ending]),)
    readings = tuple(sorted((name[: -len(e)], _KIND[e]) for e in _SHORT if len(name) > len(e) + 2 and name.endswith(e)))
    return qualifiers, readings or ((name, ""),)


def parse(address: str | None, code: str | None, town: str | None, municipality: str | None, towns: Towns) -> Parts | None:
    """The parts of an address, or None where it names neither a house nor a box."""
    text = re.sub(r"\s+", " ", fold(address or "")).strip()
    if not text:
        return None
    known = ()
    if code and (found := _CODE.search(fold(code))) and found[1] in towns.by_code:
        known = (towns.by_code[found[1]],)
    if not known and town and (name := towns.named(town)):
        known = (name,)
    box = _BOX.search(text)
    if box:
        rest = text[: box.start()] + " , " + text[box.end() :]
    else:
        rest = text
        for noise in _NOISE:
            rest = noise.sub(" , ", rest)
    if not known:
        for found in _CODE.finditer(rest):
            if found[1] in towns.by_code:
                known = (towns.by_code[found[1]],)
                break
    # Four digits are a post code, valid or not, unless nothing else can be the house number; the words after it are its town.
    parts = []
    last = 0
    others = len(_HOUSE.findall(_CODE.sub(" ", rest)))
    for found in _CODE.finditer(rest):
        if found[1] in towns.by_code or len(found[0]) > 4 or others:
            parts.append(rest[last : found.start()])
            after = re.match(r" *([a-z]+)", rest[found.end() :])
            name = towns.named(after[1]) if after else None
            last = found.end() + (after.end() if name else 0)
            known = known or ((name,) if name else ())
    rest = " , ".join([*parts, rest[last:]])
    segments = []
    for segment in re.split(r"[,()]| - ", rest):
        segment = segment.strip(" .-")
        if segment and not any(c.isdigit() for c in segment) and (name := towns.named(segment)):
            known = known or (name,)
        elif segment:
            last_word = re.search(r"(?<=[\d. a-z]) ([a-z]{4,})$", segment)
            if last_word and (name := towns.named(last_word[1])):
                known = known or (name,)
                segment = segment[: last_word.start()].strip(" .-")
            segments.append(segment)
    if not known and municipality:
        known = tuple(sorted(towns.by_municipality.get(fold(municipality), ())))
    if box:
        return Parts("box", (), (), int(box[1]), "", known)
    # The house number: the first number that is left.
    for k, segment in enumerate(segments):
        found = _HOUSE.search(segment)
        if not found:
            continue
        before = _WORD.findall(re.sub(r"\b(?:nr|no)[. ]*$", " ", segment[: found.start()]))
        words = before or _WORD.findall(segment[found.end() :])
        if not words and k and not any(c.isdigit() for c in segments[k - 1]):
            words = _WORD.findall(segments[k - 1])
        if not words and k + 1 < len(segments):
            words = _WORD.findall(segments[k + 1])
        if not words:
            continue
        return Parts("house", *street(words), int(found[1]), found[2] or "", known)
    return None
