"""Address records that denote the same building or post box.

1. Each address text is read into street, number, letter or box, and town
   (``address_parts``).  House or box, number, letter and town are the *block*; what the
   street is called in a record is its *form*, empty for a box.  Records with the same
   block and form are copies and take part as one row, so a place with very many
   records does not grow the work.
2. Forms of a block are hashed by MinHash over the padded 2-grams of the name and the
   name as a token; forms that share a band are candidates.
3. A candidate pair is verified by an affine-gap alignment of its tokens (word
   before the name, name, kind of street).  Substitution is free between spellings
   that the dictionaries give for the same word, and costs the typing errors of a name.
4. Verified forms of a block are united; the unions stay within a block, so they
   need no rounds over the corpus.

Defined results: null and blank addresses, addresses without house or box number
and addresses that tell no town are in no place.  Where only a municipality of several
towns is told, these together are the town.  A record that is repeated
counts once.  Rows may carry any other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.llm.address_parts import Parts, Towns, parse
from tindra.session import stored

#: Bands of one row each: two names that share a quarter of their 2-grams meet in one with probability 0.999.
BANDS = 24
#: Costs of the alignment; a pair is accepted up to LIMIT.
SUBSTITUTED_LETTER, OTHER_EDIT, GAP_OPEN, GAP_EXTEND, LIMIT, NEVER = 1.6, 1.0, 2.5, 0.5, 3.1, 9.0


def form_of(parts: Parts) -> str:
    """The street as one text: qualifiers, then readings as name and kind."""
    return ",".join(parts.qualifiers) + "|" + ";".join(f"{name}:{kind}" for name, kind in parts.readings)


def _edits(a: str, b: str) -> float:
    """Weighted edits, swapped neighbours as one; names of up to five letters may differ by one edit."""
    allowed = LIMIT if min(len(a), len(b)) > 5 else SUBSTITUTED_LETTER
    if abs(len(a) - len(b)) * OTHER_EDIT > allowed:
        return NEVER
    before: list[float] = []
    row = [j * OTHER_EDIT for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i * OTHER_EDIT]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + OTHER_EDIT, row[j - 1] + OTHER_EDIT, before[j - 1] + (SUBSTITUTED_LETTER if x != y else 0.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + OTHER_EDIT)
            row.append(cost)
        if min(row) > allowed:
            return NEVER
    return row[-1] if row[-1] <= allowed else NEVER


def _substitution(a: tuple[str, str], b: tuple[str, str]) -> float:
    if a[0] != b[0]:
        return NEVER
    if a[0] == "qualifier":
        return 0.0 if set(a[1].split(",")) & set(b[1].split(",")) else NEVER
    if a[0] == "kind":
        return 0.0 if a[1] == b[1] else OTHER_EDIT if not a[1] or not b[1] else NEVER
    return _edits(a[1], b[1])


def align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Least cost of a global alignment of two token lists with affine gaps."""
    big = 1e9
    m = np.full((len(a) + 1, len(b) + 1), big)
    x, y = m.copy(), m.copy()  # a gap in b, a gap in a
    m[0, 0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i, j] = min(m[i - 1, j - 1], x[i - 1, j - 1], y[i - 1, j - 1]) + _substitution(a[i - 1], b[j - 1])
            if i:
                x[i, j] = min(min(m[i - 1, j], y[i - 1, j]) + GAP_OPEN, x[i - 1, j] + GAP_EXTEND)
            if j:
                y[i, j] = min(min(m[i, j - 1], x[i, j - 1]) + GAP_OPEN, y[i, j - 1] + GAP_EXTEND)
    return min(m[-1, -1], x[-1, -1], y[-1, -1])


def same_street(a: str, b: str) -> bool:
    """Whether two forms can name the same street, under any of their readings."""

    def token_lists(form: str) -> list[list[tuple[str, str]]]:
        qualifiers, _, readings = form.partition("|")
        first = [("qualifier", qualifiers)] if qualifiers else []
        return [[*first, ("name", name), ("kind", kind)] for name, _, kind in (r.partition(":") for r in readings.split(";"))]

    return any(align(x, y) <= LIMIT for x in token_lists(a) for y in token_lists(b))


def _family(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 2**31, bands, dtype=np.int64) | 1, rng.integers(0, 2**31, bands, dtype=np.int64)


def minhashes(forms: pd.Series, bands: int = BANDS) -> list[np.ndarray]:
    """The MinHash values of each form over the 2-grams and the names of its readings."""
    mask = (1 << 31) - 1
    factors, shifts = _family(bands)
    shingles, starts = [], []
    for form in forms:
        starts.append(len(shingles))
        for reading in form.partition("|")[2].split(";"):
            name = reading.partition(":")[0]
            padded = f"^{name}$"
            shingles.extend(ord(p) * 131 + ord(q) for p, q in zip(padded, padded[1:], strict=False))
            token = 17
            for c in name:
                token = (token * 131 + ord(c)) & mask
            shingles.append(token)
    x = np.array(shingles, dtype=np.int64)
    if not len(x):
        return []
    hashed = ((x[:, None] * factors) ^ (x[:, None] >> 7) * shifts) & mask
    hashed = (hashed * 0x9E3779B1 + shifts) & mask
    return list(np.minimum.reduceat(hashed, np.array(starts), axis=0))


def parsed_records(records: DataFrame, places: DataFrame) -> DataFrame:
    """(record_id, block, form) of records with columns record_id, address, code, town, municipality.

    ``places`` is the list of post codes (a fixed public register of a few thousand
    rows); it is collected.
    """
    towns = places.select("postnummer", "poststed", "kommune").distinct().collect()
    shared = records.sparkSession.sparkContext.broadcast([tuple(r) for r in towns])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Towns(shared.value)
        for frame in frames:
            result = []
            for record, address, code, town, municipality in frame.itertuples(index=False, name=None):
                parts = parse(address, code, town, municipality, known)
                if parts and parts.towns:
                    result.append((record, f"{parts.kind}|{'/'.join(sorted(parts.towns))}|{parts.number}{parts.letter}", form_of(parts)))
            yield pd.DataFrame(result, columns=["record_id", "block", "form"])

    rows = records.select(*(F.col(c).cast("string") for c in ("record_id", "address", "code", "town", "municipality")))
    rows = rows.where(r"record_id is not null and address rlike '\\d'")
    return rows.mapInPandas(read, "record_id string, block string, form string").distinct()


def _links(forms: DataFrame) -> DataFrame:
    """(block, a, b) of the verified pairs of forms of one block."""

    @F.pandas_udf("array<bigint>")
    def bands_of(form: pd.Series) -> pd.Series:
        return pd.Series(minhashes(form), dtype=object)

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_street(p, q) for p, q in zip(a, b, strict=True)], dtype=bool)

    several = forms.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    banded = forms.join(several, "block").select("block", "form", F.posexplode(bands_of("form")).alias("band", "hash"))
    a, b = banded.withColumnRenamed("form", "a"), banded.withColumnRenamed("form", "b")
    candidates = a.join(b, ["block", "band", "hash"]).where("a < b").select("block", "a", "b").distinct()
    return candidates.where(verified("a", "b"))


def unite(links: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """(block, node, label) of the connected components of links that never leave their block.

    Blocks are placed whole and sorted, so a task holds the nodes of one block at a
    time.  The label is the least node of the component.
    """

    def components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def root(node: str) -> str:
            parent.setdefault(node, node)
            while parent[node] != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        current, out = None, []

        def flush() -> None:
            out.extend((current, node, root(node)) for node in list(parent))
            parent.clear()

        for frame in frames:
            for key, p, q in frame.itertuples(index=False, name=None):
                if key != current:
                    flush()
                    current = key
                low, high = sorted((root(p), root(q)))
                parent[high] = low
            yield pd.DataFrame(out, columns=["block", "node", "label"])
            out = []
        flush()
        yield pd.DataFrame(out, columns=["block", "node", "label"])

    placed = links.select(F.col(block).alias("block"), F.col(a).alias("a"), F.col(b).alias("b")).repartition("block").sortWithinPartitions("block")
    return placed.mapInPandas(components, "block string, node string, label string")


def places_of(records: DataFrame, places: DataFrame) -> DataFrame:
    """(record_id, place_id): one row of each record that names a place; stores the parsed records."""
    parsed = stored(parsed_records(records, places))
    labels = unite(_links(parsed.select("block", "form").distinct()), "block", "a", "b").withColumnRenamed("node", "form")
    named = parsed.join(labels, ["block", "form"], "left")
    return named.select("record_id", F.md5(F.concat_ws("#", "block", F.coalesce("label", "form"))).alias("place_id"))


def same_place_pairs(records: DataFrame, places: DataFrame) -> DataFrame:
    """(address_a, address_b), address_a < address_b: all pairs of records of one place.  Stores the members of all places."""
    members = stored(places_of(records, places))
    several = members.groupBy("place_id").agg(F.count("*").alias("n")).where("n > 1").select("place_id")
    kept = members.join(several, "place_id", "left_semi")
    a, b = kept.withColumnRenamed("record_id", "address_a"), kept.withColumnRenamed("record_id", "address_b")
    return a.join(b, "place_id").where("address_a < address_b").select("address_a", "address_b")
