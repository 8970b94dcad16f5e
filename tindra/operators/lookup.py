"""Lookups of requested keys in stores, in the order of the request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(requested: DataFrame, store: DataFrame, key: str, ordinal: str, version: str | None = None) -> DataFrame:
    """Each requested row with the store's row of its key, null where there is none.

    Of several rows of a key the one with the greatest ``version`` is taken (any, and
    always the same, where no version is named).  Clashing columns of the store
    beside the key are dropped in favour of the request's.
    """
    rest = [c for c in store.columns if c != key and c not in requested.columns]
    order = F.struct(*(F.col(version),) if version else (), *(F.col(c).cast("string") for c in rest if store.schema[c].dataType.typeName() not in ("map", "array", "struct", "variant")))
    one = store.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s"))
    joined = requested.join(one, key, "left")
    return joined.select(*requested.columns, F.col("_s").isNotNull().alias("found"), *(F.col(f"_s.{c}").alias(c) for c in rest)).orderBy(ordinal)


def with_fallback(requested: DataFrame, stores: list[tuple[str, DataFrame]], key: str, columns: list[str]) -> DataFrame:
    """(requested..., columns..., source): each requested key's columns from the first store that has the key.

    ``source`` is null where no store has it.  The stores are told apart by name and
    united, so the request is joined once.
    """
    tagged = None
    for place, (name, store) in enumerate(stores):
        part = store.select(key, *columns, F.lit(place).alias("_place"), F.lit(name).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy(key).agg(F.min_by(F.struct(*columns, "source"), F.struct("_place", *(F.col(c).cast("string") for c in columns))).alias("_s"))
    return requested.join(first, key, "left").select(*requested.columns, *(F.col(f"_s.{c}").alias(c) for c in columns), F.col("_s.source").alias("source"))


def missing(requested: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The requested rows whose key the store lacks; a null key is missing."""
    return requested.join(store.select(key).distinct(), key, "left_anti")


def repeated(requested: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that are requested more than once."""
    return requested.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fill_gaps(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with its null or empty text columns filled from the row of ``other`` with the same key."""
    side = other.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns)).dropDuplicates([key])
    joined = df.join(side, key, "left")
    return joined.select(*(F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_o_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))
