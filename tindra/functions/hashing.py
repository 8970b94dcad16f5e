"""Content hashes and the ids made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 in hex over the parts; a null part counts as the word None, so positions stay apart."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256)


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(content_hash(*parts), 1, length))


def rank_key(seed: str, c: Column) -> Column:
    """The order of a seeded sample: hex digits compare as the numbers they are."""
    return F.sha2(F.concat(F.lit(seed + ":"), c.cast("string")), 256)


def set_hash(c: Column) -> Column:
    """Aggregate: SHA-256 over the distinct values in order, one a line; collects the set, so it is for keys of samples."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), "\n"), 256)


def sequence_hash(c: Column, place: Column) -> Column:
    """Aggregate: SHA-256 over the values in the order of their place; for samples, whose keys fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("p"), c.cast("string").alias("v"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["v"]), ""), 256)
