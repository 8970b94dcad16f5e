"""Text that was decoded with the wrong character encoding: found, and restored where possible.

1. *Statistics.*  Adjacent character pairs of the whole corpus (all rows of all given
   text columns) are counted in one pass.  A pair's association is its pointwise
   mutual information plus its own log probability, so that the pairs of a garbled
   sequence, which only ever occur together, do not pass for normal.
2. *Runs.*  In each text the maximal scoring segments of ``threshold - association``
   are the improbable runs (Ruzzo and Tompa); a run is widened over the unbroken
   stretch of non-ASCII characters that it touches.
3. *Inverse mappings.*  Only inside the runs, each pair of (decoding used, encoding
   meant) is inverted.  A mapping is taken when the restored text is more probable
   under the same pair statistics by ``margin`` for each replaced sequence; the rounds
   repeat, as texts are garbled more than once.

The statistics are relative frequencies, and none is taken to be less than ``FLOOR``,
seen or not, at any size of the corpus.  The ``MOST`` most frequent pairs are
broadcast.  Where a corpus has more, the pairs of the texts that look improbable
without them are fetched by a join, so that no statistic is out of reach.

Defined results: null and empty texts are no case and stay as they are.  U+FFFD stands
in no text by intent, so its pairs are improbable by definition: a run with it is a
case that is not restorable (the character is gone); other runs are still restored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.session import stored

#: Least relative frequency that a pair is taken to have; with ``RAREST`` the scale of the smoothing.
FLOOR, RAREST = 5e-8, 5e-7
#: Mappings that are weighed together; a text garbled more often takes further passes.
_AHEAD = 4
#: Pairs that are broadcast at most.
MOST = 2_000_000
# Encodings that texts were read with, and those that they were written in.
READ_AS = ("cp1252", "latin_1", "iso8859_15", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850", "cp865", "cp866", "mac_roman", "cp1254", "cp1257", "cp1253", "iso8859_5", "mac_cyrillic")
_ONE_BYTE = ("cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850", "cp865", "cp866", "mac_roman", "iso8859_5", "mac_cyrillic")
WRITTEN_IN = ("cp850", "cp865", "mac_roman")
#: One-byte texts are read with anything when they were written in cp1252, and the other way round.
SWAPS = [(wrong, "cp1252") for wrong in _ONE_BYTE] + [(wrong, true) for wrong in ("cp1252", "latin_1") for true in WRITTEN_IN]
_REMEMBERED = 200_000
_NARROW = 0x250
_CLASSES_FROM = 0x3000
#: The symbol of U+FFFD.
_LOST = _CLASSES_FROM + 0x11FF


def symbols(text: str) -> np.ndarray:
    """Code points; beyond the alphabets a character stands for its block of 256."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(points < _CLASSES_FROM, points, np.where(points == 0xFFFD, _LOST, _CLASSES_FROM + (points >> 8)))


def pair_counts(texts: list[DataFrame]) -> DataFrame:
    """(pair, n) over one-column frames of text; a text's ends pair with a line break."""
    corpus = texts[0].toDF("text")
    for more in texts[1:]:
        corpus = corpus.unionByName(more.toDF("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        narrow, wide = np.zeros(_NARROW * _NARROW, dtype=np.int64), {}
        for frame in frames:
            values = frame["text"].tolist()
            for k in range(0, len(values), 2000):
                s = symbols("\n" + "\n".join(values[k : k + 2000]) + "\n")
                a, b = s[:-1], s[1:]
                small = (a < _NARROW) & (b < _NARROW)
                narrow += np.bincount(a[small] * _NARROW + b[small], minlength=_NARROW * _NARROW)
                for pair, n in zip(*np.unique(a[~small] << 21 | b[~small], return_counts=True), strict=True):
                    wide[int(pair)] = wide.get(int(pair), 0) + int(n)
        at = np.flatnonzero(narrow)
        yield pd.DataFrame({"pair": np.concatenate(((at // _NARROW) << 21 | at % _NARROW, np.array(list(wide), dtype=np.int64))), "n": np.concatenate((narrow[at], np.array(list(wide.values()), dtype=np.int64)))})

    return corpus.where("text <> ''").mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class PairModel:
    """Relative frequencies of pairs and characters; ``rest`` (pair, n) are pairs that are not broadcast."""

    pairs: np.ndarray
    frequency: np.ndarray
    single: np.ndarray | None = None
    rest: DataFrame | None = None
    total: float = 1.0
    #: Frequencies of further pairs, set for one text at a time.
    more: dict[int, float] = field(default_factory=dict)
    #: Log probabilities of pairs; a cache of bounded size.
    memo: dict[int, float] = field(default_factory=dict)
    #: Runs between their neighbours that no mapping improves; a cache of bounded size.
    dull: set[tuple[str, str, str]] = field(default_factory=set)

    def __post_init__(self) -> None:
        order = np.argsort(self.pairs)
        self.pairs, self.frequency = self.pairs[order], self.frequency[order]
        if self.single is None:
            self.single = np.bincount(self.pairs >> 21, self.frequency, _CLASSES_FROM + 0x1200)

    def frequencies(self, codes: np.ndarray) -> np.ndarray:
        """Of pairs, 0 where there is none."""
        k = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
        f = np.where(self.pairs[k] == codes, self.frequency[k], 0.0) if len(self.pairs) else np.zeros(len(codes))
        if self.more:
            for at in np.flatnonzero(f == 0):
                f[at] = self.more.get(int(codes[at]), 0.0)
        return f

    def association(self, s: np.ndarray) -> np.ndarray:
        """Of each adjacent pair: log of f(ab) squared over f(a) f(b)."""
        f = np.maximum(self.frequencies(s[:-1] << 21 | s[1:]), FLOOR)
        single = np.where(self.single > 0, self.single, RAREST / 2)
        result = 2 * np.log(f) - np.log(single[s[:-1]]) - np.log(single[s[1:]])
        return np.where((s[:-1] == _LOST) | (s[1:] == _LOST), -50.0, result)

    def log_probability(self, text: str) -> float:
        """Of a text's characters after its first, each given the one before."""
        memo, total, a = self.memo, 0.0, -1
        if len(memo) > _REMEMBERED:
            memo.clear()
        for c in text:
            b = ord(c)
            if b >= _CLASSES_FROM:
                b = _LOST if b == 0xFFFD else _CLASSES_FROM + (b >> 8)
            if a >= 0:
                if (step := memo.get(a << 21 | b)) is None:
                    step = memo[a << 21 | b] = self._step(a, b)
                total += step
            a = b
        return total

    def _step(self, a: int, b: int) -> float:
        f, k = float(self.frequencies(np.array([a << 21 | b]))[0]), 1e-6
        fb = max(float(self.single[b]), RAREST / 10)
        return math.log((f + k * fb) / (float(self.single[a]) + k))

    def missing(self, text: str) -> list[int]:
        """The pairs of a text that the model does not hold."""
        s = symbols(f"\n{text}\n")
        codes = s[:-1] << 21 | s[1:]
        return np.unique(codes[self.frequencies(codes) == 0]).tolist()


def fit(texts: list[DataFrame], most: int = MOST) -> PairModel:
    """The pair model of all rows of the given one-column frames.  Runs a job; brings at most ``most`` pairs to the driver."""
    counts = stored(pair_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 1
    firsts = counts.groupBy(F.shiftright("pair", 21).alias("a")).agg(F.sum("n").alias("n")).toPandas()  # a row for each character or block
    single = np.bincount(firsts["a"].to_numpy(np.int64), firsts["n"].to_numpy(np.float64) / total, _CLASSES_FROM + 0x1200)
    wanted, rest = counts.where(F.col("n") > FLOOR * total), None
    if wanted.count() > most:
        wanted, rest = wanted.where(F.col("n") * most >= total), wanted.where(F.col("n") * most < total)
    rows = wanted.select("pair", "n").toPandas()
    return PairModel(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.float64) / total, single, rest, float(total))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, end) of a list of scores, in linear time."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for k, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low, high = k, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((start, k + 1, low, high))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b) for a, b, _, _ in stack]


def improbable(texts: list[str], model: PairModel, threshold: float = -8.0) -> list[str]:
    """The texts with an improbable pair at a non-ASCII character: only these can have a run."""
    kept = []
    for k in range(0, len(texts), 4000):
        part = texts[k : k + 4000]
        s = symbols("\n" + "\n".join(part) + "\n")
        starts = np.cumsum([0] + [len(t) + 1 for t in part])
        low = (model.association(s) < threshold) & ((s[:-1] > 0x7E) | (s[1:] > 0x7E))
        rows = np.unique(np.searchsorted(starts, np.flatnonzero(low), side="right") - 1)
        kept.extend(part[r] for r in rows if r < len(part))
    return kept


def spans_of(text: str, association: np.ndarray, threshold: float = -8.0) -> list[tuple[int, int]]:
    """Character spans of the improbable runs, widened over unbroken non-ASCII text; ``association`` is of the pairs of the text between two line breaks."""
    scores = np.clip(threshold - association, -4.0, 6.0)
    merged: list[list[int]] = []
    for a, b in segments(scores.tolist()):
        start, end = max(a - 1, 0), min(b, len(text))  # pair k is of the characters k - 1 and k of the text
        while start > 0 and text[start - 1] > "\x7e":
            start -= 1
        while end < len(text) and text[end] > "\x7e":
            end += 1
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def runs_of(text: str, association: np.ndarray, threshold: float = -8.0) -> list[tuple[int, int]]:
    """The improbable runs that hold a character beyond ASCII."""
    return [(a, b) for a, b in spans_of(text, association, threshold) if any(c > "\x7e" for c in text[a:b])]


@lru_cache(maxsize=1)
def _bytes() -> dict[str, dict[str, int]]:
    """Of each reading encoding the byte of each character; bytes it leaves out are control characters, as browsers have it."""
    tables = {}
    for name in READ_AS:
        table = {}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        tables[name] = table
    return tables


@lru_cache(maxsize=1)
def _swaps() -> dict[tuple[str, str], dict[str, str]]:
    """Character to character for each pair of one-byte encodings."""
    swaps = {}
    for wrong, true in SWAPS:
        swap = {}
        for char, b in _bytes()[wrong].items():
            try:
                meant = bytes([b]).decode(true)
            except UnicodeDecodeError:
                continue
            if meant != char:
                swap[char] = meant
        swaps[wrong, true] = swap
    return swaps


@lru_cache(maxsize=1)
def _leads() -> dict[str, frozenset[str]]:
    """Of each reading encoding the characters whose byte begins a sequence of UTF-8."""
    return {name: frozenset(c for c, b in table.items() if 0xC2 <= b < 0xF5) for name, table in _bytes().items()}


#: What a sequence of UTF-8 may have been when its bytes 80 to 9F were dropped as control characters.
_CUT = {"Ã": [chr(x) for x in range(0xC0, 0xE0)], "â": [chr(x) for x in (*range(0x2010, 0x2020), 0x2022, 0x2026)]}


def _from_utf8(run: str, table: dict[str, int]) -> tuple[str, int] | None:
    """The run with its stretches of valid UTF-8 decoded, and how many characters that made."""
    result, made, k = [], 0, 0
    while k < len(run):
        b = table.get(run[k], 0)
        width = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if width and k + width <= len(run):
            # A no-break space is often turned into a space on the way.
            rest = [table.get(c, 0xA0 if c == " " else 0) for c in run[k + 1 : k + width]]
            try:
                result.append(bytes([b, *rest]).decode("utf-8"))
                made += 1
                k += width
                continue
            except (UnicodeDecodeError, ValueError):
                pass
        result.append(run[k])
        k += 1
    return ("".join(result), made) if made else None


def _recased(run: str) -> list[str]:
    """The run, and the run as it was before its accented letters changed case."""
    upper = "".join(c.upper() if "\xe0" <= c <= "\xff" and len(c.upper()) == 1 and c.upper() < "\xff" else c for c in run)
    lower = "".join(c.lower() if "\xc0" <= c <= "\xdf" else c for c in run)
    return list(dict.fromkeys((run, upper, lower)))


def _candidates(run: str) -> Iterator[tuple[str, int, list[str], dict[str, str] | None]]:
    """(restored run, sequences replaced, names of the mappings undone, the outermost first, one-byte swap or None)."""
    seen, level = {run}, [(run, [])]
    for _ in range(_AHEAD):
        deeper = []
        for current, names in level:
            variants = [(v, set(v)) for v in _recased(current)]
            for wrong, table in _bytes().items():
                for variant, chars in variants:
                    if chars.isdisjoint(_leads()[wrong]):
                        continue
                    if (found := _from_utf8(variant, table)) and found[0] not in seen:
                        seen.add(found[0])
                        deeper.append((found[0], [*names, f"utf_8 read as {wrong}"]))
                        yield found[0], found[1], deeper[-1][1], None
        level = deeper
    for lead, options in _CUT.items():
        if n := run.count(lead):
            for option in options:
                yield run.replace(lead, option), n, ["utf_8 read as latin_1, control characters dropped"], {lead: option}
    for (wrong, true), swap in _swaps().items():
        if n := sum(c in swap for c in run):
            text = "".join(swap.get(c, c) for c in run)
            if text not in seen:
                seen.add(text)
                yield text, n, [f"{true} read as {wrong}"], swap


_SHIFTED = re.compile(r"\+([A-Za-z0-9/]{3,})-?")


def _from_utf7(text: str, model: PairModel, threshold: float, margin: float) -> tuple[str, list[str]]:
    """UTF-7 that was read as ASCII, undone in the shift sequences of the improbable runs where that makes the text more probable."""
    undone: list[str] = []
    spans = spans_of(text, model.association(symbols(f"\n{text}\n")), threshold)
    shifted = [found for found in _SHIFTED.finditer(text) if any(a < found.end() and found.start() < b for a, b in spans)]
    for found in reversed(shifted):
        a, b = found.span()
        try:
            meant = base64.b64decode(found[1] + "=" * (-len(found[1]) % 4)).decode("utf-16-be")
        except ValueError:
            continue
        if not meant or meant.isascii() or not meant.isprintable():
            continue
        left, right = ("\n" + text)[a], (text + "\n")[b]
        if model.log_probability(left + meant + right) - model.log_probability(left + text[a:b] + right) > margin:
            text = text[:a] + meant + text[b:]
            undone.append("utf_7 read as ascii")
    return text, undone


def variants(text: str, model: PairModel, threshold: float) -> Iterator[str]:
    """The text, and what its runs may have been between their neighbours: all that ``restore`` weighs."""
    yield text
    spans = spans_of(text, model.association(symbols(f"\n{text}\n")), threshold)
    for a, b in spans:
        for restored, _, _, swap in _candidates(text[a:b]) if any(c > "\x7e" for c in text[a:b]) else ():
            yield ("\n" + text)[a] + restored + (text + "\n")[b]
            if swap:
                yield "".join(swap.get(c, c) for c in text)
    for found in _SHIFTED.finditer(text):
        try:
            yield ("\n" + text)[found.start()] + base64.b64decode(found[1] + "=" * (-len(found[1]) % 4)).decode("utf-16-be") + (text + "\n")[found.end()]
        except ValueError:
            continue


def restore(text: str, model: PairModel, threshold: float = -8.0, margin: float = 2.0) -> tuple[str, list[str]]:
    """The restored text and the mappings undone; an empty list where nothing is.

    Runs are restored from right to left, each by the mapping that gains most; further
    passes see the restored neighbours, until none gains.
    """
    text, undone = _from_utf7(text, model, threshold, margin) if "+" in text else (text, [])
    changed = True
    while changed:  # every change makes the text more probable, so this ends
        changed = False
        s = symbols("\n" + text + "\n")
        for a, b in reversed(runs_of(text, model.association(s), threshold)):
            left, right = ("\n" + text)[a], (text + "\n")[b]
            run = text[a:b]
            if (left, run, right) in model.dull:
                continue
            before = model.log_probability(left + run + right)
            best, best_gain, names, dull = None, 0.0, [], True
            for restored, n, mappings, swap in _candidates(run):
                gain = model.log_probability(left + restored + right) - before
                if gain <= max(best_gain, margin * n):
                    continue
                dull = False
                if swap:  # the same characters elsewhere in the text must bear it out
                    same = {c: swap[c] for c in run if c in swap}
                    everywhere = "".join(same.get(c, c) for c in text)
                    more = model.log_probability(f"\n{everywhere}\n") - model.log_probability(f"\n{text}\n")
                    padded = f" {text} "
                    borne = any(x in same and (not same[x].isalpha() or padded[k].isalpha() or padded[k + 2].isalpha()) for k, x in enumerate(text))
                    if not borne or more <= margin * sum(c in same for c in text):
                        continue
                if all(c.isprintable() or c in "\xad\xa0" for c in restored if c not in run):
                    best, best_gain, names = restored, gain, mappings
            if dull:
                if len(model.dull) >= _REMEMBERED:
                    model.dull.clear()
                model.dull.add((left, run, right))
            if best is not None:
                text, changed = text[:a] + best + text[b:], True
                undone += names
    return text, undone


def find_garbled(df: DataFrame, key: str, text: str, model: PairModel, threshold: float = -8.0, margin: float = 2.0) -> DataFrame:
    """(key, original, restored, mappings, restorable) of the rows whose text is garbled, wholly or in part.

    No shuffle: each task scores its own rows, each distinct text of a batch once.
    ``restorable`` is false where a character was lost for good.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.pairs, model.frequency, model.single))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("original")).where(F.col("original").rlike(r"[^\x00-\x7e]|\+[A-Za-z0-9/]{3}"))
    rows = rows.withColumn("more", F.lit(None).cast("array<struct<pair:bigint,n:bigint>>"))
    total = model.total
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, original string, restored string, mappings array<string>, restorable boolean"

    def suspects(values: list[str], own: PairModel) -> set[str]:
        return set(improbable(values, own, threshold)) | {v for v in values if _SHIFTED.search(v)}

    if model.rest is not None:  # what the broadcast table does not hold, for the texts that look improbable without it

        def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = PairModel(*shared.value)
            for frame in frames:
                values = list(dict.fromkeys(frame["original"]))
                found = sorted(suspects(values, own))
                yield pd.DataFrame({"original": found, "codes": [sorted({c for x in variants(v, own, threshold) for c in own.missing(x)}) for v in found]})

        texts = rows.select("original").mapInPandas(pick, "original string, codes array<bigint>").dropDuplicates(["original"])
        pairs = texts.select("original", F.explode("codes").alias("pair")).join(model.rest, "pair")
        fetched = pairs.groupBy("original").agg(F.collect_list(F.struct("pair", "n")).alias("more"))
        rows = rows.drop("more").join(texts.select("original").join(fetched, "original", "left"), "original").select("_key", "original", "more")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PairModel(*shared.value)
        known: dict[str, tuple[str, list[str], bool] | None] = {}

        def judge(value: str, more) -> tuple[str, list[str], bool] | None:
            own.more = {x["pair"]: x["n"] / total for x in more} if more is not None else {}
            if own.more:
                own.memo.clear()
            runs = runs_of(value, own.association(symbols(f"\n{value}\n")), threshold)
            lost = any("\ufffd" in value[a:b] for a, b in runs)
            restored, undone = restore(value, own, threshold, margin)
            if own.more:
                own.more = {}
                own.memo.clear()
            return (restored, undone, not lost) if undone or lost else None

        for frame in frames:
            values, further = frame["original"].tolist(), dict(zip(frame["original"], frame["more"], strict=True))
            new = [v for v in dict.fromkeys(values) if v not in known]
            odd = suspects(new, own)
            known = {v: known[v] for v in dict.fromkeys(values) if v in known} | {v: judge(v, further[v]) if v in odd else None for v in new}
            hit = [v for v in values if known[v]]
            at = [k for k, v in enumerate(values) if known[v]]
            if not at:
                continue
            yield pd.DataFrame({"_key": frame["_key"].iloc[at].to_numpy(), "original": hit, "restored": [known[v][0] for v in hit], "mappings": [known[v][1] for v in hit], "restorable": [known[v][2] for v in hit]})

    return rows.mapInPandas(search, schema).withColumnRenamed("_key", key)
