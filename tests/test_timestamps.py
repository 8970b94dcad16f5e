"""Timestamps against a plain reading with the standard library."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tindra.operators.timestamps import normal_forms, rewritten

OSLO = ZoneInfo("Europe/Oslo")
MONTHS = "januar februar mars april mai juni juli august september oktober november desember".split()
ENGLISH = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def one(text, zone="Europe/Oslo"):
    return normal_forms(pd.Series([text], dtype=object), zone)[0]


def test_days():
    for text in ("2026-10-15", "15. oktober 2026", "15/10/2026", "15.10.26", "20261015", " 2026-10-15 ", "Oct 15, 2026", "2026-288", "2026-W42-4", "torsdag 15. oktober 2026", "15. OKT. 2026", "2026/10/15"):
        assert one(text) == "2026-10-15", text


def test_instants():
    for text in (
        "2026-01-02T03:04:05+01:00", "2026-01-02 03:04:05 CET", "2026-01-02T03:04:05", "02.01.2026 03:04:05", "2026-01-02T02:04:05Z", "Fri, 02 Jan 2026 02:04:05 GMT",
        "Mon, 02 Jan 2026 03:04:05 +0100", "1767319445", "1767319445000", "/Date(1767319445000+0100)/", "20260102T020405Z", "2026-W01-5T02:04:05Z", "2026-002T02:04:05Z", "2026-01-02T03:04:05[Europe/Oslo]",
        "1 Jan 2026 21:04:05 EST", "\t2026-01-02T02:04:05Z\xa0",
    ):
        assert one(text) == "2026-01-02T02:04:05.000000Z", text
    assert one("Jan 2, 2026 12:05 AM UTC") == "2026-01-02T00:05:00.000000Z"
    assert one("2. januar 2026 klokka 15.05") == "2026-01-02T14:05:00.000000Z"
    assert one("2026-01-01T24:00:00Z") == "2026-01-02T00:00:00.000000Z"
    assert one("2026-01-02T02:04:05.123456789Z") == "2026-01-02T02:04:05.123456Z"


def test_neither():
    for text in (None, "", " ", "løpende", "n/a", "2026-02-31", "00.00.0000", "31.11.2025", "2026-13-01", "2026-W54-1", "2026-366", "2025-03-30 02:30:00", "2025-10-26T02:30:00", "26.10.2025 kl. 02.59", "2026-01-02T25:00:00Z", "2026-01-02T03:04:05 XYZ", "x" * 10_000):
        assert one(text) is None, text
    assert one("2025-03-30 02:30:00", "UTC") == "2025-03-30T02:30:00.000000Z"
    assert one("2025-10-26T02:30:00+02:00") == "2025-10-26T00:30:00.000000Z"


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2080, 1, 1)))
def test_round_trip(t):
    t = t.replace(microsecond=0)
    both = {t.replace(tzinfo=OSLO, fold=f).astimezone(timezone.utc) for f in (0, 1)}
    back = {u.astimezone(OSLO).replace(tzinfo=None) for u in both}
    want = next(iter(both)).strftime("%Y-%m-%dT%H:%M:%S.000000Z") if len(both) == 1 and back == {t} else None
    for text in (t.strftime("%Y-%m-%d %H:%M:%S"), t.strftime("%d.%m.%Y %H:%M:%S"), f"{t.day} {ENGLISH[t.month - 1]} {t.year} {t:%H:%M:%S}"):
        assert one(text) == want, text
    assert one(f"{t.day}. {MONTHS[t.month - 1]} {t.year}") == t.strftime("%Y-%m-%d")
    shifted = (t + timedelta(hours=5, minutes=30)).strftime("%Y-%m-%dT%H:%M:%S+05:30")
    assert one(shifted) == t.strftime("%Y-%m-%dT%H:%M:%S.000000Z")


def test_rewritten(spark):
    df = spark.createDataFrame([("a", "2026-01-02", "x"), ("a", "2026-01-02", "x"), ("b", "02.01.2026", "x"), ("b", "02.01.2026", "x"), ("c", None, "x"), ("d", "2026-01-02T00:00:00.000000Z", "x")], "id string, t string, field string")
    assert [tuple(r) for r in rewritten(df, "id", ["t"]).collect()] == [("b", "t", "2026-01-02")]
