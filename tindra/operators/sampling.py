"""Reproducible samples: the order is a hash of seed and key, never the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions.hashing import rank_key
from tindra.session import checkpoint


#: Leading bits of a hash by which ranks are counted: at most 2^20 counts, whatever the number of rows.
_BITS = 20


def _bound(df: DataFrame, prefix: Column, k: int) -> DataFrame:
    """One row with ``_bound``: the least prefix up to which at least ``k`` rows lie, the greatest there is where there are fewer.

    Rows are counted by the leading bits of their hash, so the bound is exact for any
    number of rows of one key; the counts combine on the map side.
    """
    counts = df.groupBy(prefix.alias("_p")).agg(F.count("*").alias("_n"))
    through = counts.select("_p", F.sum("_n").over(Window.orderBy("_p")).alias("_t"))  # over 2^_BITS rows at most
    return through.agg(F.coalesce(F.min(F.when(F.col("_t") >= k, F.col("_p"))), F.max("_p")).alias("_bound"))


def bottom_k(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """The ``k`` rows of least rank, with the column ``rank_hash``; rows of equal keys tie and are told apart by nothing; null keys are left out.

    A top list takes ``k`` rows from every task, so ranks above an exact bound are
    dropped first.  Only the key is read for the bound.
    """
    prefix = F.substring(rank_key(seed, F.col(key)), 1, _BITS // 4)
    bound = _bound(df.where(F.col(key).isNotNull()), prefix, k)
    ranked = df.where(F.col(key).isNotNull()).withColumn("rank_hash", rank_key(seed, F.col(key))).crossJoin(F.broadcast(bound))  # one row
    return ranked.where(F.substring("rank_hash", 1, _BITS // 4) <= F.col("_bound")).drop("_bound").orderBy("rank_hash", key).limit(k)


def least_hashed(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The ``k`` rows of least 64-bit hash of seed and key, as ``bottom_k`` but for keys of any type and without the hash."""
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    bound = _bound(df, F.shiftrightunsigned(mixed, 64 - _BITS), k)
    ranked = df.withColumns({"_u": F.shiftrightunsigned(mixed, 32), "_h": mixed}).crossJoin(F.broadcast(bound))  # one row
    return ranked.where(F.shiftrightunsigned("_h", 64 - _BITS) <= F.col("_bound")).orderBy("_u", "_h", key).limit(k).drop("_u", "_h", "_bound")


def least_hashed_of_each(df: DataFrame, key: str, group: str, groups: list[str], k: int, seed: int) -> DataFrame:
    """The ``k`` rows of least hash of each of the named groups; a short list, as its bounds are broadcast."""
    named = df.where(F.col(group).isin(groups))
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    counts = named.groupBy(F.col(group).alias("_g"), F.shiftrightunsigned(mixed, 64 - _BITS).alias("_p")).agg(F.count("*").alias("_n"))
    through = counts.withColumn("_t", F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")))  # over 2^_BITS rows at most
    bounds = through.groupBy("_g").agg(F.coalesce(F.min(F.when(F.col("_t") >= k, F.col("_p"))), F.max("_p")).alias("_bound"))
    near = named.withColumn("_h", mixed).join(F.broadcast(bounds), F.col(group) == F.col("_g")).where(F.shiftrightunsigned("_h", 64 - _BITS) <= F.col("_bound"))
    w = Window.partitionBy("_g").orderBy(F.shiftrightunsigned("_h", 32), "_h", key)  # over little more than k rows
    return near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_h", "_g", "_bound", "_rn")


def preserve_then_fill(df: DataFrame, key: str, preserved: DataFrame, k: int, seed: str) -> DataFrame:
    """(key, is_preserved, position): the eligible preserved keys first, the rest by rank, then one seeded order of all.

    Too many preserved keys are cut by a rank of their own.
    """
    keys = df.select(key).distinct()
    kept = bottom_k(keys.join(preserved.select(key).distinct(), key, "left_semi"), key, k, f"{seed}:preserved").select(key)
    filled = bottom_k(keys.join(preserved.select(key).distinct(), key, "left_anti"), key, k, seed).withColumnRenamed("rank_hash", "_h")
    both = kept.select(key, F.lit(True).alias("is_preserved"), F.lit("").alias("_h")).unionByName(filled.select(key, F.lit(False).alias("is_preserved"), "_h"))
    taken = both.orderBy(F.desc("is_preserved"), "_h", key).limit(k)
    order = Window.orderBy(rank_key(f"{seed}:order", F.col(key)), key)  # over k rows
    return taken.select(key, "is_preserved", F.row_number().over(order).alias("position"))


def split_by_position(sample: DataFrame, position: str, shares: tuple[tuple[str, float], ...] = (("train", 0.6), ("validation", 0.2), ("test", 0.2))) -> DataFrame:
    """Adds ``split`` by place in a sample of known order; bounds are rounded half to even and the last split takes the rest."""
    total = sample.agg(F.count("*").alias("_n"))
    name, bound = None, F.lit(0)
    for label, share in shares[:-1]:
        bound = bound + F.bround(F.col("_n") * share).cast("bigint")
        name = F.when(F.col(position) <= bound, label) if name is None else name.when(F.col(position) <= bound, label)
    return sample.crossJoin(F.broadcast(total)).withColumn("split", name.otherwise(shares[-1][0])).drop("_n")  # one row


def size_band(employees: Column) -> Column:
    """Head counts by band; unknown is a band of its own."""
    return F.when(employees.isNull(), "unknown").when(employees == 0, "0").when(employees < 5, "1-4").when(employees < 20, "5-19").when(employees < 100, "20-99").otherwise("100+")


def stratum(*parts: Column) -> Column:
    """The parts joined by a bar, null as ``none``."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("none")) for p in parts))


def per_stratum(df: DataFrame, key: str, strata: Column, n: int, seed: str) -> DataFrame:
    """Adds ``stratum`` and ``place``: at most ``n`` rows of each stratum, by rank.

    Spark ranks before it shuffles (a group limit on the window), so a stratum of
    a third of all rows sends ``n`` rows from each task.
    """
    w = Window.partitionBy("stratum").orderBy("rank_hash", key)
    ranked = df.withColumn("stratum", strata).withColumn("rank_hash", rank_key(seed, F.col(key)))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def one_per_group(df: DataFrame, key: str, group: str, n: int, seed: str, used: DataFrame | None = None) -> DataFrame:
    """The ``n`` groups of least rank with their row of least rank; groups of ``used`` are left out, as are rows without group."""
    rows = df.where(F.col(group).isNotNull())
    if used is not None:
        rows = rows.join(used.select(group).distinct(), group, "left_anti")
    first = rows.groupBy(group).agg(F.min(F.struct(rank_key(seed, F.col(key)).alias("rank_hash"), F.col(key).alias(key))).alias("_m"))
    rows = first.select(group, f"_m.{key}", "_m.rank_hash")
    return rows.orderBy("rank_hash", key).limit(n)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``position`` from 0 in the given order, which has to be total.

    Rows are placed in ranges and checkpointed; a row's position is its place in its
    range and the sizes of the ranges before, so no task sees all rows.
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def every_step(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Every ``count div n``-th row in order, ``n`` rows at most, with ``position`` from 0."""
    total = df.agg(F.greatest(F.floor(F.count("*") / n), F.lit(1)).alias("_step"))
    rows = numbered(df, order).crossJoin(F.broadcast(total))  # one row
    return rows.where((F.col("position") % F.col("_step") == 0) & (F.col("position") < F.col("_step") * n)).drop("_step")
