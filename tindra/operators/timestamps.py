"""One unambiguous form for timestamps that were written in many formats and zones.

A value is reduced to its *shape mask* (digits ``9``, letters ``a``, other
characters as they are).  All values of one mask have their fields at the same
offsets, so a mask is matched against the layouts once and the values under it
are cut, checked and converted as numpy arrays.  Zone-less clock times go through
transition tables of a named version of the time zone database.

Defined results
---------------
* null, blank, remarks, days that do not exist, clock times out of range: null
* a clock time without zone that its default zone skipped or had twice: null
* a wrong weekday is ignored, an unknown word makes the value null
* further digits of a second than six are cut off
* ``24:00`` is the midnight that ends the day (ISO 8601); any other hour above 23, and second ``60``, are out of range
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of months and weekdays, hours of the zone abbreviations, clock words.
MONTHS = (
    ("januar", "january", "jan"),
    ("februar", "february", "feb"),
    ("mars", "march", "mar"),
    ("april", "apr"),
    ("mai", "may", "maj"),
    ("juni", "june", "jun"),
    ("juli", "july", "jul"),
    ("august", "aug"),
    ("september", "sep", "sept"),
    ("oktober", "october", "okt", "oct"),
    ("november", "nov"),
    ("desember", "december", "des", "dec"),
)
WEEKDAYS = (
    "mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag", "måndag", "tysdag", "laurdag", "sundag",
    "man", "tir", "tirs", "ons", "tor", "tors", "fre", "lør", "søn",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
)
ZONE_HOURS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 1, "west": 1, "cet": 1, "met": 1, "cest": 2, "mest": 2,
    "eet": 2, "eest": 3, "msk": 3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
    "akst": -9, "akdt": -8, "hst": -10, "jst": 9, "kst": 9, "aest": 10, "aedt": 11,
}
CLOCK_WORDS = ("kl", "klokka", "klokken", "at", "t")

_MONTH = {name: k + 1 for k, names in enumerate(MONTHS) for name in names}
_YMD = r"(?P<Y>9999)(?P<_p>[-/.])(?P<m>99?)(?P=_p)(?P<d>99?)"
_DMY = r"(?P<d>99?)(?P<_p>[-/.])(?P<m>99?)(?P=_p)(?P<Y>9999|99)"
_COMPACT = r"(?P<Y>9999)(?P<m>99)(?P<d>99)"
_ORDINAL = r"(?P<Y>9999)-(?P<j>999)"
_WEEK = r"(?P<Y>9999)-?(?P<W>a)(?P<w>99)-?(?P<wd>9)"
_NAMED = r"(?:(?P<day>a+)\.?,? )?(?P<d>99?)\.? (?P<mon>a+)\.?,? (?P<Y>9999|99)"
_NAMED_FIRST = r"(?:(?P<day>a+)\.?,? )?(?P<mon>a+)\.? (?P<d>99?),? (?P<Y>9999)"
_TIME = r"(?P<H>99?)[:.](?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9+))?)?"
_TIME_COMPACT = r"(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?"
_GAP = r"(?:(?P<kl>a)|, | - | |,? (?P<kl2>a+)\.? )"
_ZONE = r"(?: ?(?P<x1>a+)(?: (?P<x2>a+))?)?(?: ?(?P<os>[-+])(?P<oh>99)(?::?(?P<om>99))?)?(?:\[(?P<zid>[a/_+-]+)\])?"
LAYOUTS = [
    re.compile(r"(?P<epoch>9{10}|9{13}|9{16})"),
    re.compile(r"(?P<epoch>9{10})\.(?P<ef>9+)"),
    re.compile(r"/(?P<json>aaaa)\((?P<epoch>9{13})(?:[-+]9999)?\)/"),
    *(re.compile(d) for d in (_YMD, _DMY, _COMPACT, _ORDINAL, _WEEK, _NAMED, _NAMED_FIRST)),
    *(re.compile(d + _GAP + _TIME + _ZONE) for d in (_YMD, _DMY, _ORDINAL, _WEEK, _NAMED, _NAMED_FIRST)),
    *(re.compile(d + "(?P<kl>a)" + t + _ZONE) for d in (_COMPACT, _ORDINAL, _WEEK) for t in (_TIME_COMPACT, _TIME)),
]
_DAY_US = 86_400_000_000
#: Seconds: bounds of the transition tables, and the 400 years after which the calendar repeats.
_YEAR_1800, _YEAR_2500, _CYCLE = -5_364_662_400, 16_725_225_600, 146_097 * 86_400
#: Outside of years 1 to 9999 there is no normal form.
_LOWEST, _HIGHEST = (int(np.datetime64(x, "us").astype(np.int64)) for x in ("0001-01-01", "9999-12-31T23:59:59.999999"))


class _Classes(dict):
    """Code point to the character of its class, filled in as code points occur."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        self[point] = "9" if "0" <= char <= "9" else "a" if char.isalpha() else char
        return self[point]


_CLASSES = _Classes()


def parser_of(mask: str) -> tuple[tuple[str, int, int], ...] | None:
    """The fields (name, start, end) of a mask, or None where no layout has it."""
    return _remembered(mask) if len(mask) <= 256 else _looked_up(mask)  # long masks are rare and would fill the memory


def _looked_up(mask: str) -> tuple[tuple[str, int, int], ...] | None:
    for layout in LAYOUTS:
        if found := layout.fullmatch(mask):
            return tuple((k, *found.span(k)) for k, v in found.groupdict().items() if v is not None and k != "_p")
    return None


_remembered = lru_cache(maxsize=65536)(_looked_up)


def zone_database_version() -> str:
    """The version of the installed time zone database: of its package, else of the system's files."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    from pathlib import Path
    from zoneinfo import TZPATH

    for folder in TZPATH:
        if (named := Path(folder, "tzdata.zi")).is_file():
            return named.open(encoding="utf-8").readline().split()[-1]
        if (named := Path(folder, "+VERSION")).is_file():
            return named.read_text().strip()
    return "system"


@lru_cache(maxsize=64)
def transitions(zone: str, version: str | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(UTC microseconds from which, offset in microseconds) of a zone, by version of the database; None if unknown.

    Found by probing each week of the years 1800 to 2500 and halving to the second; what
    comes later repeats every 400 years.  A ``version`` other than the installed one is an error, so that two runs never
    mix tables unseen.
    """
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    if version not in (None, zone_database_version()):
        raise ValueError(f"time zone database {version} is asked for, {zone_database_version()} is installed")
    try:
        info = ZoneInfo(zone)
    except Exception:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(second: int) -> int:
        return int((epoch + timedelta(seconds=second)).astimezone(info).utcoffset().total_seconds())

    day, start, end = 86_400, _YEAR_1800, _YEAR_2500
    at, offsets = [_LOWEST // 1_000_000], [offset(start)]
    for low in range(start, end, 7 * day):
        high = low + 7 * day
        while offset(high) != offsets[-1]:
            a, b = low, high
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if offset(middle) == offsets[-1] else (a, middle)
            at.append(b)
            offsets.append(offset(b))
            low = b
    return np.array(at, dtype=np.int64) * 1_000_000, np.array(offsets, dtype=np.int64) * 1_000_000


def to_utc(local: np.ndarray, zone: str, version: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Local to UTC microseconds, and whether the clock showed that time exactly once."""
    table = transitions(zone, version)
    if table is None:
        return local, np.zeros(len(local), dtype=bool)
    at, offsets = table
    turns = np.maximum(local // 1_000_000 - _YEAR_2500 + 40 * 86_400 + _CYCLE, 0) // _CYCLE * (_CYCLE * 1_000_000)  # whole 400-year cycles beyond the table
    of = lambda utc: offsets[np.maximum(np.searchsorted(at, utc - turns, side="right") - 1, 0)]
    before, after = of(local - _DAY_US), of(local + _DAY_US)
    first, second = local - before, local - after
    first_ok, second_ok = of(first) == before, of(second) == after
    once = np.where(before == after, first_ok, first_ok ^ second_ok)
    return np.where(first_ok, first, second), once


def _numbers(points: np.ndarray, start: int, end: int) -> np.ndarray:
    return (points[:, start:end].astype(np.int64) - 48) @ (10 ** np.arange(end - start - 1, -1, -1, dtype=np.int64))


def _words(values: list[str], start: int, end: int, table) -> np.ndarray:
    """The table's entry of each word in lower case, -99 where it has none."""
    get = table.get
    return np.array([get(v[start:end].lower(), -99) for v in values], dtype=np.int64)


def _days(field: dict, points: np.ndarray, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the day exists."""
    year = _numbers(points, *field["Y"])
    year = year + 2000 if field["Y"][1] - field["Y"][0] == 2 else year
    ok = year >= 1
    january = ((year - 1970) * 12).astype("datetime64[M]")
    if "j" in field:
        nth = _numbers(points, *field["j"])
        length = ((january + 12).astype("datetime64[D]") - january.astype("datetime64[D]")).astype(np.int64)
        return january.astype("datetime64[D]").astype(np.int64) + nth - 1, ok & (nth >= 1) & (nth <= length)
    if "w" in field:
        week, day = _numbers(points, *field["w"]), _numbers(points, *field["wd"])
        fourth = january.astype("datetime64[D]").astype(np.int64) + 3
        monday = fourth - (fourth + 3) % 7 + (week - 1) * 7
        ok &= (_words(values, *field["W"], {"w": 1}) == 1) & (day >= 1) & (day <= 7)
        return monday + day - 1, ok & ((monday + 3).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970 == year)
    month = _numbers(points, *field["m"]) if "m" in field else _words(values, *field["mon"], _MONTH)
    ok &= (month >= 1) & (month <= 12)
    first = january + np.where(ok, month - 1, 0)
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    day = _numbers(points, *field["d"])
    if "day" in field:
        ok &= _words(values, *field["day"], dict.fromkeys(WEEKDAYS, 1)) == 1
    return first.astype("datetime64[D]").astype(np.int64) + day - 1, ok & (day >= 1) & (day <= length)


def _convert(mask: str, values: list[str], zone: str, version: str | None) -> np.ndarray | None:
    """The normal forms of values that share a mask (None where there is none)."""
    if (parser := parser_of(mask)) is None:
        return None
    field = {k: (a, b) for k, a, b in parser}
    points = np.array(values, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(values), len(mask))
    ok = np.ones(len(values), dtype=bool)
    if "epoch" in field:
        length = field["epoch"][1] - field["epoch"][0]
        utc = _numbers(points, *field["epoch"]) * 10 ** (16 - length)
        if "ef" in field:
            a, b = field["ef"]
            b = min(b, a + 6)
            utc += _numbers(points, a, b) * 10 ** (6 - (b - a))
        if "json" in field:
            ok = _words(values, *field["json"], {"date": 1}) == 1
    else:
        days, ok = _days(field, points, values)
        days = np.where(ok, days, 0)
        if "H" not in field:
            text = np.datetime_as_string(days.astype("datetime64[D]")).astype(object)
            text[~ok] = None
            return text
        hour, minute = _numbers(points, *field["H"]), _numbers(points, *field["M"])
        second = _numbers(points, *field["S"]) if "S" in field else 0
        micro = 0
        if "f" in field:
            a, b = field["f"]
            b = min(b, a + 6)
            micro = _numbers(points, a, b) * 10 ** (6 - (b - a))
        for k in ("kl", "kl2"):
            if k in field:
                ok &= _words(values, *field[k], dict.fromkeys(("t",) if k == "kl" else CLOCK_WORDS, 1)) == 1
        # The words after the time: at most one of AM and PM, then at most one zone.
        half, hours = np.full(len(values), -99), np.full(len(values), -99)
        for k in ("x1", "x2"):
            if k in field:
                am, z = _words(values, *field[k], {"am": 0, "pm": 12}), _words(values, *field[k], ZONE_HOURS)
                ok &= np.where(am > -99, (half == -99) & (hours == -99), (z > -99) & (hours == -99))
                half, hours = np.where(am > -99, am, half), np.where(z > -99, z, hours)
        midnight = (hour == 24) & (minute == 0) & (second == 0) & (micro == 0)
        ok &= np.where(half > -99, (hour >= 1) & (hour <= 12), (hour < 24) | midnight) & (minute < 60) & (second < 60)
        hour = np.where(half > -99, hour % 12 + half, hour)
        local = days * _DAY_US + ((hour * 60 + minute) * 60 + second) * 1_000_000 + micro
        if "os" in field:
            sign = np.where(points[:, field["os"][0]] == ord("-"), -1, 1)
            oh, om = _numbers(points, *field["oh"]), _numbers(points, *field["om"]) if "om" in field else 0
            ok &= (oh <= 18) & (om < 60)
            # After UTC or GMT an offset counts from there; after another abbreviation it contradicts it.
            ok &= (hours == -99) | (hours == 0)
            utc = local - sign * (oh * 60 + om) * 60_000_000
        else:
            utc = local - hours * 3_600_000_000
            unzoned = hours == -99
            if "zid" in field:
                names = np.array([v[slice(*field["zid"])] for v in values], dtype=object)
            else:
                names = np.full(len(values), zone, dtype=object)
            for name in set(names[unzoned]):
                at = unzoned & (names == name)
                utc[at], once = to_utc(local[at], name, version)
                ok[at] &= once
    ok &= (utc >= _LOWEST) & (utc <= _HIGHEST)
    text = np.char.add(np.datetime_as_string(np.where(ok, utc, 0).astype("datetime64[us]"), unit="us"), "Z").astype(object)
    text[~ok] = None
    return text


def normal_forms(values: pd.Series, zone: str = "UTC", version: str | None = None) -> pd.Series:
    """The normal form of each text, None where it names neither a day nor an instant."""
    result = np.full(len(values), None, dtype=object)
    rows = [(k, v.strip()) for k, v in enumerate(values) if isinstance(v, str)]
    by_mask: dict[str, tuple[list[int], list[str]]] = {}
    for k, text in rows:
        if text:
            at, texts = by_mask.setdefault(text.translate(_CLASSES), ([], []))
            at.append(k)
            texts.append(text)
    for mask, (at, texts) in by_mask.items():
        if (forms := _convert(mask, texts, zone, version)) is not None:
            result[at] = forms
    return pd.Series(result, dtype=object)


def normalise(value: Column, zone: str = "UTC", version: str | None = None) -> Column:
    """Column of the normal form: ``YYYY-MM-DD`` or ``YYYY-MM-DDTHH:MM:SS.ffffffZ``, null where the text names neither."""

    version = version or zone_database_version()  # the driver's, which every worker has to have too

    @F.pandas_udf(StringType())
    def forms(texts: pd.Series) -> pd.Series:
        return normal_forms(texts, zone, version)

    # Marked so that a filter on the result is not pushed below it as a second call.
    return forms.asNondeterministic()(value)


#: A text of one of these shapes is its own normal form or has none.
_IN_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}Z)?$"


def rewritten(df: DataFrame, key: str, fields: list[str], zone: str = "UTC", version: str | None = None) -> DataFrame:
    """(record_id, field, normal_form) of the values that denote a day or instant and are not written in normal form.

    Values already of a normal form's shape are settled by a pattern in the JVM and
    never reach Python.  Repeated rows count once.
    """
    long = df.select(
        F.col(key).cast("string").alias("record_id"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields))).alias("v"),
    ).select("record_id", "v.field", "v.value")
    odd = long.where(F.col("value").rlike("[0-9]") & ~F.col("value").rlike(_IN_FORM))  # every form holds a digit
    return (
        odd.withColumn("normal_form", normalise(F.col("value"), zone, version))
        .where(F.col("normal_form").isNotNull() & (F.col("normal_form") != F.col("value")))
        .select("record_id", "field", "normal_form")
        .distinct()
    )
