"""Evidence records: states, content-addressed bodies, provenance, and rules that records must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions.urls import canonical

# The published states, and older names for them.
STATES = ("available", "not_available", "blocked", "not_applicable", "ambiguous", "failed")
OLDER_NAMES = {
    "not_found": "not_available",
    "source_error": "failed",
    "not_fetched": "failed",
    "budget_exhausted": "failed",
    "submission_error": "failed",
    "complete": "available",
    "blocked_policy": "blocked",
    "blocked_robots": "blocked",
}


def state(status: Column) -> Column:
    """The published state of a status; null, unknown and oddly written ones are ``failed``."""
    result = F.when(status.isin(*STATES), status)
    for old, new in OLDER_NAMES.items():
        result = result.when(status == old, new)
    return result.otherwise("failed")


def state_of_fetch(status: Column, records: Column | None = None) -> Column:
    """The state of a fetch by its HTTP status; an empty list of records counts as not available."""
    empty = F.coalesce(records == 0, F.lit(False)) if records is not None else F.lit(False)
    return (
        F.when((status == 200) & empty, "not_available")
        .when(status == 200, "available")
        .when(status.isin(404, 410), "not_available")
        .when(status.isin(401, 403, 429, 451), "blocked")
        .otherwise("failed")
    )


def latest_of_key(df: DataFrame, key: list[str], version: Column, columns: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest version; combines on the map side, so redeliveries do not travel.

    With ``columns`` only those come out beside the key, and only those are read.
    """
    rest = [c for c in (df.columns if columns is None else columns) if c not in key]
    if not rest:
        return df.select(*key).distinct()
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*")


def store_bodies(bodies: DataFrame, body: str, kind: str, existing: DataFrame | None = None) -> DataFrame:
    """(sha256, kind, body, is_new): each distinct body once; null bodies are left out.

    ``is_new`` is false for what ``existing`` (sha256, kind) already holds.
    """
    named = bodies.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.col(kind).alias("kind"), F.col(body).alias("body"))
    once = named.groupBy("sha256", "kind").agg(F.first("body").alias("body"))
    if existing is None:
        return once.withColumn("is_new", F.lit(True))
    seen = existing.select("sha256", "kind").distinct().withColumn("_seen", F.lit(True))
    return once.join(seen, ["sha256", "kind"], "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def attach_references(records: DataFrame, pages: DataFrame, urls: list[str], page_url: str, reference: str) -> DataFrame:
    """``records`` with the page reference of the first of their ``urls`` that has a page; a reference that is there stays.

    ``pages`` has one address and its reference; of several with the same canonical
    address the least reference counts.
    """
    known = pages.select(canonical(F.col(page_url)).alias("_u"), F.col(reference).alias("_ref")).where("_u is not null and _ref is not null")
    known = known.groupBy("_u").agg(F.min("_ref").alias("_ref"))
    result = records
    for k, url in enumerate(urls):
        side = known.select(F.col("_u").alias(f"_u{k}"), F.col("_ref").alias(f"_ref{k}"))
        result = result.join(side, canonical(F.col(url)) == F.col(f"_u{k}"), "left").drop(f"_u{k}")
    found = [F.col(reference)] if reference in records.columns else []
    merged = F.coalesce(*found, *(F.col(f"_ref{k}") for k in range(len(urls))))
    return result.withColumn(reference, merged).drop(*(f"_ref{k}" for k in range(len(urls))))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in the order given; a rule that is null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))


#: What every record that is counted has to say of itself.
def provenance_rules(source_url: str = "source_url", retrieved_at: str = "retrieved_at", content_hash: str = "content_sha256") -> dict[str, Column]:
    return {
        "source_url": F.col(source_url).rlike(r"^https?://[^/ ]+\.[^/ ]+"),
        "retrieved_at": F.trim(F.col(retrieved_at)) != "",
        "content_hash": F.col(content_hash).rlike(r"^[0-9a-f]{64}$"),
    }


def carry_forward(current: DataFrame, previous: DataFrame, key: list[str], status: str = "state") -> DataFrame:
    """``current`` with failed rows replaced by the previous row of their key where that was available; adds ``carried_forward``."""
    rest = [c for c in current.columns if c not in key]
    old = previous.where(F.col(status) == "available").select(*key, F.struct(*rest).alias("_old")).dropDuplicates(key)
    joined = current.join(old, key, "left").withColumn("carried_forward", (F.col(status) == "failed") & F.col("_old").isNotNull())
    return joined.select(*key, *(F.when(F.col("carried_forward"), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in rest), "carried_forward")


def observation_rules(platforms: tuple[str, ...], signals: tuple[str, ...]) -> dict[str, Column]:
    """What an observation has to keep to be counted, for ``violations``."""
    return {
        "id": F.trim("id") != "",
        "organisation_number": F.col("organisation_number").rlike("^[0-9]{9}$"),
        "platform": F.col("platform").isin(*platforms),
        "signal_type": F.col("signal_type").isin(*signals),
        **{k: v for k, v in provenance_rules().items() if k != "retrieved_at"},
    }
