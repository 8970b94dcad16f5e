"""Days in texts as sites publish them, as Column expressions.

Texts of one value that may be an instant belong to ``operators.timestamps``; here a day
is looked for anywhere in a text.  Day and month are checked against 1-31 and 1-12
only, an ISO day not at all, so an impossible day such as 31 February stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, words before a date of publication and before a deadline, words for no deadline.
MONTHS = {
    1: ("januar", "january", "jan"), 2: ("februar", "february", "feb"), 3: ("mars", "march", "mar"), 4: ("april", "apr"), 5: ("mai", "may"), 6: ("juni", "june", "jun"),
    7: ("juli", "july", "jul"), 8: ("august", "aug"), 9: ("september", "sep", "sept"), 10: ("oktober", "october", "okt", "oct"), 11: ("november", "nov"), 12: ("desember", "december", "des", "dec"),
}
PUBLISHED = "publisert|oppdatert|dato|posted|published|date"
DEADLINE = "søknadsfrist|frist|deadline|søknad innen|application deadline"
AT_ONCE = "snarest|asap|fortløpende|løpende"

_EDGE, _END = "(?:^|[^0-9A-Za-z_])", "(?:[^0-9A-Za-z_]|$)"
ISO = _EDGE + r"(20\d{2}-[01]\d-[0-3]\d)(?:T|[^0-9A-Za-z_]|$)"
NUMBERS = _EDGE + r"([0-3]?\d)[./-]([01]?\d)[./-](20\d{2})" + _END
NAMED = _EDGE + r"([0-3]?\d)\.?[ \t\n\r]+([a-zA-ZæøåÆØÅ]+)[ \t\n\r]+(20\d{2})" + _END
_NUMERIC, _WORDED = r"[0-3]?\d[./-][01]?\d[./-]20[12]\d", r"[0-3]?\d\.?[ \t\n\r]+[a-zA-ZæøåÆØÅ]+[ \t\n\r]+20[12]\d"
#: In order; the first that gives a day counts.
PUBLICATION = (
    f"(?:{PUBLISHED})[ \\t\\n\\r]*[:-]?[ \\t\\n\\r]*({_NUMERIC})",
    f"(?:{PUBLISHED})[ \\t\\n\\r]*[:-]?[ \\t\\n\\r]*({_WORDED})",
    _EDGE + r"(20[12]\d-[01]\d-[0-3]\d)" + _END,
    _EDGE + f"({_NUMERIC})" + _END,
    _EDGE + f"({_WORDED})" + _END,
)
DEADLINES = (f"(?:{DEADLINE})[ \\t\\n\\r]*[:-]?[ \\t\\n\\r]*({_NUMERIC})", f"(?:{DEADLINE})[ \\t\\n\\r]*[:-]?[ \\t\\n\\r]*({_WORDED})")
NO_DEADLINE = f"(?:{DEADLINE})[ \\t\\n\\r]*[:-]?[ \\t\\n\\r]*(?:{AT_ONCE})"
WITHIN = f"(?:innen|before)[ \\t\\n\\r]+({_NUMERIC})"
ADDRESSES = (r"/(20\d{2})/([01]?\d)/([0-3]?\d)(?:/|$)", r"(?:^|[/_-])(20\d{2})-([01]\d)-([0-3]\d)(?:[/_-]|$)", r"/(20\d{2})([01]\d)([0-3]\d)(?:[-_]|/|$)")


def _made(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (c.try_cast("int") for c in (year, month, day))
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def day_of(c: Column) -> Column:
    """YYYY-MM-DD of the first ISO day in a text, else of a day in numbers (day before month), else of one with the month's name; null for none."""
    iso = F.regexp_extract(c, ISO, 1)
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)
    name = F.lower(part(NAMED, 2))
    month = F.lit("")
    for k, names in MONTHS.items():
        month = F.when(name.isin(*names), str(k)).otherwise(month)
    return F.coalesce(F.when(iso != "", iso), _made(part(NUMBERS, 3), part(NUMBERS, 2), part(NUMBERS, 1)), _made(part(NAMED, 3), month, part(NAMED, 1)))


def day_in_text(c: Column) -> Column:
    """The day of publication that a text tells: after a word for it, else the first ISO day, day in numbers or named day."""
    return F.coalesce(*(day_of(F.regexp_extract(c, "(?iu)" + p, 1)) for p in PUBLICATION))


def deadline_in_text(c: Column) -> Column:
    """The day after a word for a deadline, or ``snarest`` where one says as soon as possible; null for none."""
    dated = [day_of(F.regexp_extract(c, "(?iu)" + p, 1)) for p in DEADLINES]
    return F.coalesce(*dated, F.when(c.rlike("(?iu)" + NO_DEADLINE), "snarest"), day_of(F.regexp_extract(c, "(?iu)" + WITHIN, 1)))


def day_in_address(path: Column) -> Column:
    """The day in an address's path: /2026/08/10/, 2026-08-10 or /20260810-."""
    return F.coalesce(*(_made(*(F.regexp_extract(path, p, k) for k in (1, 2, 3))) for p in ADDRESSES))
