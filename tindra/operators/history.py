"""Comparisons in time: field changes, observation gaps, append-only logs, timelines and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.functions.hashing import short_id


def field_changes(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of keys in both frames; values compare as text, null equals null.

    Keys are taken to be unique in each frame.
    """
    pair = previous.select(F.col(key), *(F.col(f).cast("string").alias(f"_o_{f}") for f in fields)).join(current.select(F.col(key), *(F.col(f).cast("string").alias(f"_n_{f}") for f in fields)), key)
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old_value"), F.col(f"_n_{f}").alias("new_value")) for f in fields))
    differ = F.filter(cells, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return pair.select(key, F.explode(differ).alias("c")).select(key, "c.*")


def unmatched_keys(previous: DataFrame, current: DataFrame, *key: str) -> DataFrame:
    """(key..., side): keys that only one of two frames has."""
    sides = previous.select(*key, F.lit(1).alias("_s")).unionByName(current.select(*key, F.lit(2).alias("_s")))
    return sides.groupBy(*key).agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a = b").select(*key, F.when(F.col("a") == 1, "previous").otherwise("current").alias("side"))


def removed_or_unseen(previous: DataFrame, current: DataFrame, key: list[str], carrier: str, crawled: DataFrame, *owner: str) -> DataFrame:
    """(key..., change_type) of items that are gone: REMOVED where their carrier was looked at again, else OBSERVATION_GAP.

    ``crawled`` has ``owner`` and an array ``urls`` of what was looked at; an item
    without carrier counts as removed.
    """
    gone = previous.join(current.select(*key).distinct(), key, "left_anti")
    looked = gone.join(crawled.select(*owner, "urls"), [*owner], "left")
    seen = F.exists(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.contains(F.col(carrier), u))
    return looked.select(*key, F.when(F.col(carrier).isNull() | F.coalesce(seen, F.lit(False)), "REMOVED").otherwise("OBSERVATION_GAP").alias("change_type"))


def change_ids(changes: DataFrame, *parts: str, prefix: str = "chg-") -> DataFrame:
    """Adds ``change_id``, the same for the same change whenever it is derived."""
    return changes.withColumn("change_id", short_id(prefix, *(F.col(p) for p in parts)))


def new_heads(log: DataFrame, snapshots: DataFrame, key: str, identity: str, order: Column) -> DataFrame:
    """The snapshots to append: those whose identity is not that of their key's last entry in the log."""
    heads = log.groupBy(key).agg(F.max_by(identity, order).alias("_head"))
    return snapshots.join(heads, key, "left").where(~F.col(identity).eqNullSafe(F.col("_head"))).drop("_head")


def timeline(events: DataFrame, key: str, day: str, as_of: Column, n: int = 20, tie: list[Column] | None = None) -> DataFrame:
    """The newest ``n`` events of each key that are not after ``as_of``, with their ``place``; undated events are left out."""
    dated = events.where(F.col(day).isNotNull() & (F.col(day) <= as_of))
    w = Window.partitionBy(key).orderBy(F.desc(day), *(tie or []))
    return dated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def trend(df: DataFrame, key: str, period: str, amount: str, keep: int = 3) -> DataFrame:
    """(key, period, amount, before, change_pct) of each key's newest period against the one before it that is kept.

    ``change_pct`` is null where nothing came before or that was 0.  One row of each
    key and period is taken (the greatest amount).
    """
    rows = df.where(F.col(period).isNotNull()).groupBy(key, period).agg(F.max(amount).alias(amount))
    w = Window.partitionBy(key).orderBy(F.desc(period))
    ranked = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    known = ranked.where(F.col(amount).isNotNull())
    w2 = Window.partitionBy(key).orderBy(F.desc(period))
    pairs = known.withColumn("before", F.lead(amount).over(w2)).withColumn("_k", F.row_number().over(w2)).where("_k = 1")
    change = F.when(F.col("before") != 0, F.bround((F.col(amount) - F.col("before")) / F.abs("before") * 100, 1))
    return pairs.select(key, period, amount, "before", change.alias("change_pct"))


def added(previous: DataFrame, current: DataFrame, owners: DataFrame, owner: list[str], item: list[str], keep: list[str] | None = None) -> DataFrame:
    """(owner..., item..., keep...): the items of the current frame that the previous lacks, of owners that were there before.

    One union and one aggregation by owner and item tell them; the owners are met by a join.
    """
    columns = [*owner, *item, *(keep or [])]
    sides = previous.select(*columns, F.lit(1).alias("_s")).unionByName(current.select(*columns, F.lit(2).alias("_s")))
    first = sides.groupBy(*owner, *item).agg(F.min("_s").alias("_s"), *(F.max(c).alias(c) for c in keep or []))
    return first.where("_s = 2").drop("_s").join(owners.select(*owner).distinct(), owner, "left_semi").select(*columns)


def keyed(snapshots: DataFrame, key: str, delivery: str, claims: str, ignored: tuple[str, ...] = ("retrieved_at", "captured_at", "query_time")) -> DataFrame:
    """Adds ``profile_hash`` of the claims, one a line in the order of their names without nulls and times of collection, and ``snapshot_key`` made of key, delivery and hash."""
    known = F.filter(F.map_entries(claims), lambda e: e["value"].isNotNull() & ~e["key"].isin(*ignored))
    lines = F.transform(F.array_sort(F.coalesce(known, F.array().cast("array<struct<key:string,value:string>>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    hashed = snapshots.withColumn("profile_hash", F.sha2(F.array_join(lines, "\n"), 256))
    return hashed.withColumn("snapshot_key", short_id("snap-", F.col(key), F.col(delivery), F.col("profile_hash")))
