"""What changed between consecutive full deliveries of a table.

Every row is tagged twice, as the current side of its own delivery and as the
previous side of the next one, and reduced on the map side to hashes; one
aggregation by key then holds both sides and classifies them.  The group state is
one row per side, so a key with very many redeliveries does not grow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "ADDED", "REMOVED", "CHANGED"
#: Times of collection, which are no content.
TIMES = ("retrieved_at", "captured_at", "query_time")

_ENTITY = "array<struct<entity_type:string,entity_key:string,hash:bigint>>"


def consecutive(df: DataFrame, delivery: str) -> DataFrame:
    """(delivery, side, pair) for each delivery: it is current in its own pair and previous in that of its follower.

    One row or two per delivery, so the frame is as small as the list of deliveries.
    """
    numbers = df.select(F.col(delivery).alias("_d")).where("_d is not null").distinct()
    w = Window.orderBy("_d")
    both = numbers.select("_d", F.lag("_d").over(w).alias("_before"), F.lead("_d").over(w).alias("_next"))
    now = both.where("_before is not null").select("_d", F.lit(True).alias("_now"), F.col("_d").alias("_pair"))
    return now.unionByName(both.where("_next is not null").select("_d", F.lit(False).alias("_now"), F.col("_next").alias("_pair")))


def changes_of_keys(previous: DataFrame, current: DataFrame, key: list[str], content: list[str] | None = None) -> DataFrame:
    """(key..., change_type) between two flat snapshots whose key is unique in each up to exact copies.

    Rows with a null in the key take part as a key of their own (nulls compare
    equal).  ``content`` is all other common columns by default; null and missing
    are equal.  Copies with different content count as changed when the sets of
    contents differ.
    """
    content = content or [c for c in current.columns if c not in key and c in previous.columns]
    side = lambda df, now: df.select(*key, F.xxhash64(*(F.col(c) for c in content), F.lit(1)).alias("_h"), F.lit(now).alias("_now"))
    rows = side(previous, False).unionByName(side(current, True)).distinct()
    digest = lambda now: F.struct(F.count(F.when(F.col("_now") == now, 1)).alias("n"), F.bit_xor(F.when(F.col("_now") == now, F.col("_h"))).alias("h"))
    both = rows.groupBy(*key).agg(digest(False).alias("_p"), digest(True).alias("_c"))
    kind = F.when(F.col("_p.n") == 0, ADDED).when(F.col("_c.n") == 0, REMOVED).when((F.col("_p.n") != F.col("_c.n")) | (F.col("_p.h") != F.col("_c.h")), CHANGED)
    return both.withColumn("change_type", kind).where("change_type is not null").select(*key, "change_type")


def _items(items: Column, kind: str, key: str, content: list[str]) -> Column:
    """Entities of a list of structs; items without key are left out, null equals absent."""
    known = F.filter(F.coalesce(items, F.array()), lambda x: x.isNotNull() & x[key].isNotNull())
    return F.transform(known, lambda x: F.struct(F.lit(kind).alias("entity_type"), x[key].alias("entity_key"), F.xxhash64(F.lit(0), *(F.struct(x[c]) for c in content)).alias("hash")))


def _claims(claims: Column, ignored: tuple[str, ...]) -> Column:
    """Entities of a map; a null value equals an absent name."""
    known = F.filter(F.map_entries(claims), lambda e: e["value"].isNotNull() & ~e["key"].isin(*ignored))
    return F.transform(F.coalesce(known, F.array()), lambda e: F.struct(F.lit("claim").alias("entity_type"), e["key"].alias("entity_key"), F.xxhash64(F.lit(0), e["value"]).alias("hash")))


def profile_changes(snapshots: DataFrame, ignored: tuple[str, ...] = TIMES) -> DataFrame:
    """(delivery_no, organisation_number, entity_type, entity_key, change_type) of each delivery against the one before.

    ``snapshots`` has delivery_no, organisation_number, captured_at, snapshot_id,
    claims, jobs and activities; other columns are ignored.  A company's state in a
    delivery is its row with the latest captured_at (of several with that time, the
    one with the greatest snapshot_id).  Rows without delivery or organisation number
    are left out, as are list items without id.  A null list or map is an empty one.
    Order and repeats in lists do not count, nor do the fields in ``ignored``.
    A company in one delivery only gives one row of type ``company``.
    """
    fields = {c: [f.name for f in snapshots.schema[c].dataType.elementType.fields] for c in ("jobs", "activities")}
    content = lambda c, key: sorted(f for f in fields[c] if f not in (*ignored, key))
    entities = F.array_distinct(
        F.concat(
            _claims(F.col("claims"), ignored).cast(_ENTITY),
            _items(F.col("jobs"), "job", "job_id", content("jobs", "job_id")).cast(_ENTITY),
            _items(F.col("activities"), "activity", "activity_id", content("activities", "activity_id")).cast(_ENTITY),
        )
    )
    rows = snapshots.select(F.col("delivery_no").alias("_d"), "organisation_number", F.struct("captured_at", "snapshot_id").alias("_at"), entities.alias("_e"))
    rows = rows.where("_d is not null and organisation_number is not null")
    tagged = rows.join(F.broadcast(consecutive(snapshots, "delivery_no")), "_d")  # as many rows as there are deliveries, twice
    latest = lambda now: F.max_by(F.when(F.col("_now") == now, F.col("_e")), F.when(F.col("_now") == now, F.col("_at")))
    both = tagged.groupBy(F.col("_pair").alias("delivery_no"), "organisation_number").agg(
        latest(False).alias("_p"), latest(True).alias("_c"), F.bool_or(~F.col("_now")).alias("_before"), F.bool_or("_now").alias("_after")
    )
    names = lambda side: F.transform(F.col(side), lambda x: F.struct(x["entity_type"], x["entity_key"]))
    differ = F.array_distinct(
        F.transform(F.concat(F.array_except("_c", "_p"), F.array_except("_p", "_c")), lambda x: F.struct(x["entity_type"], x["entity_key"]))
    )
    company = lambda kind: F.array(F.struct(F.lit("company").alias("entity_type"), F.col("organisation_number").alias("entity_key"), F.lit(kind).alias("change_type")))
    within = F.transform(
        differ,
        lambda x: F.struct(
            x["entity_type"].alias("entity_type"),
            x["entity_key"].alias("entity_key"),
            F.when(~F.array_contains(F.col("_pk"), x), ADDED).when(~F.array_contains(F.col("_ck"), x), REMOVED).otherwise(CHANGED).alias("change_type"),
        ),
    )
    kinds = F.when(~F.col("_before"), company(ADDED)).when(~F.col("_after"), company(REMOVED)).otherwise(within)
    return (
        both.withColumns({"_pk": names("_p"), "_ck": names("_c")})
        .select("delivery_no", "organisation_number", F.explode(kinds).alias("x"))
        .select("delivery_no", "organisation_number", "x.entity_type", "x.entity_key", "x.change_type")
    )
