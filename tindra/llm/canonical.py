"""One form for text that looks the same but is written with different characters.

Arrow batches are turned into arrays of code points, several thousand rows at
once.  Every step is a gather through a table indexed by code point: invisible
characters vanish, spaces and hyphens unite, full-width forms, ligatures and
look-alike letters become the plain letter, letters with marks fall apart.  Then
marks are put in canonical order and composed again, by rank within their run, so
no row is ever handled as a Python string.

Two texts get the same form exactly when they differ only in such choices.  What
a reader sees as different stays different: superscripts, fractions, other
accents, dashes, quotes, case, ``l`` and ``1``.

Defined results: null gives null, empty gives empty, a text of invisible
characters only gives an empty form; texts of any length are taken whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.session import stored

# Letters that look like a Latin letter, each string beside the letters it stands for.
LOOK_ALIKES = (
    ("асԁеһіјорԛѕѵԝху", "acdehijopqsvwxy"),  # Cyrillic, small
    ("АВСЕНІЈКМОРԚЅТѴԜХҮԌ", "ABCEHIJKMOPQSTVWXYG"),  # Cyrillic, capital
    ("ӏ", "l"),
    ("οονρϲϳ", "oovpcj"),  # Greek, small
    ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖ", "ABCEHIJKMNOPTXYZ"),  # Greek, capital
    ("ɑɡ", "ag"),  # phonetic letters
    ("օ", "o"),  # Armenian
    ("ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ", "ivxlcdmIVXLCDM"),  # number letters
    ("µ", "μ"),
    ("‐‑", "--"),
    ("  ", "\n\n"),
)
# Ranges of characters that leave no mark on the page.
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
    (0xE0000, 0xE0FFF),
)
#: Compatibility decompositions of these kinds look like what they decompose to (ligatures and digraphs have none of their own kind).
_ALIKE_KINDS = ("<wide>", "<narrow>", "<noBreak>")
_LIGATURES = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
_TOP = 0x110000
#: Bytes of text that are handled at once.
CHUNK = 4 << 20


def _plain(char: str, alike: dict[str, str]) -> str:
    """Full decomposition of one character, look-alikes replaced."""
    kind, *rest = unicodedata.decomposition(char).split() or [""]
    if kind in _ALIKE_KINDS or any(a <= ord(char) <= b for a, b in _LIGATURES):
        char = "".join(chr(int(x, 16)) for x in rest)
    return "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", char))


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, made by rule from the Unicode database of the running Python."""
    alike = {a: b for left, right in LOOK_ALIKES for a, b in zip(left, right, strict=True)}
    length = np.ones(_TOP, dtype=np.int8)
    single = np.arange(_TOP, dtype=np.uint32)
    start, pool = {}, []
    classes = np.zeros(_TOP, dtype=np.uint8)
    pairs = {}
    for point in range(_TOP):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4 or 0x3400 <= point < 0xA000 or 0x20000 <= point:
            continue  # surrogates; Hangul is arithmetic; ideographs stand for themselves
        char = chr(point)
        if cls := unicodedata.combining(char):
            classes[point] = cls
        if unicodedata.category(char) == "Zs":
            single[point] = 32
        elif char in alike or unicodedata.decomposition(char):
            plain = _plain(char, alike)
            if len(plain) == 1:
                single[point] = ord(plain)
            else:
                length[point] = len(plain)
                start[point] = len(pool)
                pool.extend(map(ord, plain))
        made = unicodedata.decomposition(char).split()
        if len(made) == 2 and unicodedata.normalize("NFC", char) == char and made[0][0] != "<":
            a, b = (int(x, 16) for x in made)
            if chr(a) not in alike:
                pairs[a << 21 | b] = point
    for a, b in INVISIBLE:
        length[a : b + 1] = 0
    at = np.zeros(_TOP, dtype=np.int32)
    at[list(start)] = list(start.values())
    keys = np.array(sorted(pairs), dtype=np.int64)
    return {"length": length, "single": single, "start": at, "pool": np.array(pool, dtype=np.uint32), "class": classes, "keys": keys, "made": np.array([pairs[k] for k in keys], dtype=np.uint32)}


def _gather(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its expansion; ``rows`` are the offsets of the rows."""
    length = t["length"][points]
    offsets = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    source = np.repeat(np.arange(len(points), dtype=np.int64), length)
    result = t["single"][points[source]]
    wide = np.flatnonzero(length[source] > 1)
    if len(wide):
        result[wide] = t["pool"][t["start"][points[source[wide]]] + (wide - offsets[source[wide]])]
    return result, offsets[rows]


def _drop(points: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[rows]


def _marks(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, then composed with the letter before them."""
    cls = t["class"][points]
    if not cls.any():
        return points, rows
    starter = cls == 0
    starter[rows[:-1][rows[:-1] < len(points)]] = True  # a mark that begins a row has no letter
    run = np.cumsum(starter)
    rank_class = cls  # 0 for letters; marks without a letter are put in order too
    if ((rank_class[1:] < rank_class[:-1]) & ~starter[1:]).any():
        order = np.lexsort((rank_class, run))  # stable, and keeps the runs
        points, cls = points[order], cls[order]
    first = np.flatnonzero(starter)
    rank = np.arange(len(points)) - first[run - 1]
    points, keep = points.copy(), np.ones(len(points), dtype=bool)
    last = np.zeros(len(points), dtype=np.uint8)
    marks = np.flatnonzero(rank)
    marks = marks[np.argsort(rank[marks], kind="stable")]
    for at in np.split(marks, np.flatnonzero(np.diff(rank[marks])) + 1):
        base = at - rank[at]
        key = points[base].astype(np.int64) << 21 | points[at]
        k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        fits = (t["keys"][k] == key) & (last[base] < cls[at]) & (t["class"][points[base]] == 0)
        points[base[fits]] = t["made"][k[fits]]
        keep[at[fits]] = False
        last[base[~fits]] = cls[at[~fits]]
    return _drop(points, rows, keep)


def _hangul(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining letters to syllables."""
    for low, count, is_base, made in (
        (0x1161, 21, lambda p: (p >= 0x1100) & (p < 0x1113), lambda b, v: 0xAC00 + ((b - 0x1100) * 21 + (v - 0x1161)) * 28),
        (0x11A8, 27, lambda p: (p >= 0xAC00) & (p < 0xD7A4) & ((p - 0xAC00) % 28 == 0), lambda b, v: b + (v - 0x11A7)),
    ):
        if len(points) < 2:
            break
        second = np.flatnonzero((points[1:] >= low) & (points[1:] < low + count) & is_base(points[:-1])) + 1
        second = second[~np.isin(second, rows)]
        if len(second):
            points = points.copy()
            points[second - 1] = made(points[second - 1], points[second])
            keep = np.ones(len(points), dtype=bool)
            keep[second] = False
            points, rows = _drop(points, rows, keep)
    return points, rows


def canonical_points(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical form of rows laid end to end; ``rows`` has one offset more than there are rows."""
    t = tables()
    points, rows = _gather(points, rows, t)
    points, rows = _marks(points, rows, t)
    return _hangul(points, rows)


def canonical_array(texts: pa.Array) -> pa.Array:
    """Canonical forms of an Arrow string array, in chunks of bounded size; null stays null."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    data = texts.buffers()[2]
    chunks, k = [], 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, side="right")) - 1)
        raw = np.frombuffer(data, dtype=np.uint8, count=int(offsets[end] - offsets[k]), offset=int(offsets[k])) if data is not None and offsets[end] > offsets[k] else np.zeros(0, dtype=np.uint8)
        begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        points, rows = canonical_points(points, begins[offsets[k : end + 1] - offsets[k]])
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[rows]
        body = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        chunks.append(pa.LargeStringArray.from_buffers(end - k, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)))
        k = end
    result = pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())
    if texts.null_count:
        result = pa.compute.if_else(texts.is_valid(), result, pa.scalar(None, pa.large_string()))
    return result


def canonical_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form) of every row; other columns are left out."""
    rows = df.select(F.col(key), F.col(text))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {text} string, form string"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), canonical_array(batch.column(1)).cast(pa.string())], names=[key, text, "form"])

    return rows.mapInArrow(convert, schema)


def form_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, text_id) of every row with visible text: rows of one class look the same, rows of one text_id are identical.

    Texts go to Python once and only their forms come back.
    """
    digest = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    rows = df.select(F.struct(F.col(key).alias("key"), digest(F.col(text)).alias("text_id")).alias("_at"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = rows.select("_at", F.lit(None).cast("string").alias("form")).schema

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), canonical_array(batch.column(1)).cast(pa.string())], names=["_at", "form"])

    forms = rows.mapInArrow(convert, schema).where(r"form rlike '\\S'")
    return forms.select(F.col("_at.key").alias(key), digest(F.col("form")).alias("class_id"), F.col("_at.text_id").alias("text_id"))


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows that look the same and are not identical.

    The classes are stored, so each text is brought to its form once.  Only classes with
    at least two different texts reach the join; they are told by an aggregate of two
    values a class, so a class of many copies stays cheap until its pairs are written
    out.  Rows without key are in no pair, and a repeated row counts once.
    """
    rows = stored(form_classes(df, key, text))
    mixed = rows.groupBy("class_id").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a <> b").select("class_id")
    members = rows.where(F.col(key).isNotNull()).join(mixed, "class_id", "left_semi").distinct()
    left = members.select("class_id", F.col(key).alias("doc_a"), F.col("text_id").alias("_a"))
    right = members.select("class_id", F.col(key).alias("doc_b"), F.col("text_id").alias("_b"))
    return left.join(right, "class_id").where("doc_a < doc_b and _a <> _b").select("doc_a", "doc_b")
