"""Observations of companies from several adapters, under one schema.

An adapter is a function from its tables to a frame with the columns of ``SCHEMA``.
Adapters are united in a fixed order, and of each id the row of the first adapter that
has it is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tindra.functions.hashing import content_hash
from tindra.functions.urls import social_profile
from tindra.operators.ranking import keep_first_of_union

SCHEMA = ("id", "organisation_number", "platform", "signal_type", "source_url", "retrieved_at", "content_sha256", "metrics")
Adapter = Callable[..., DataFrame]


def observation(df: DataFrame, kind: str, key: Column, number: Column, platform: Column, signal: str, url: Column, retrieved: Column, sha: Column, metrics: dict[str, Column]) -> DataFrame:
    """Rows under the one schema; a hash that is missing or of another length is made from the company and the address."""
    made = content_hash(F.lit(kind), number, url)
    return df.select(
        F.concat(F.lit(f"{kind}-"), key).alias("id"), number.alias("organisation_number"), platform.alias("platform"), F.lit(signal).alias("signal_type"), url.alias("source_url"), retrieved.alias("retrieved_at"),
        F.when(F.length(sha) == 64, sha).otherwise(made).alias("content_sha256"), F.to_json(F.struct(*(v.cast("string").alias(k) for k, v in metrics.items()))).alias("metrics"),
    ).where("organisation_number is not null and id is not null")


def site_news(activities: DataFrame) -> DataFrame:
    """Articles of a company's own site."""
    c = F.col
    return observation(activities, "news", c("activity_id"), c("company_orgnr"), F.lit("news"), "company_announcement", c("source_url"), c("retrieved_at"), c("content_sha256"), {"title": c("title"), "type": c("activity_type"), "date": c("activity_date")})


def hiring(jobs: DataFrame) -> DataFrame:
    """Postings of a company."""
    c = F.col
    return observation(jobs, "job", c("job_id"), c("company_orgnr"), F.lit("company_website"), "job_posting", c("source_url"), c("retrieved_at"), c("content_sha256"), {"job_title": c("job_title"), "location": c("location")})


def hiring_page(jobs: DataFrame) -> DataFrame:
    """The page on which most of a company's postings were found, one for each company."""
    counts = jobs.where("found_on_url is not null and company_orgnr is not null").groupBy("company_orgnr", "found_on_url").agg(F.count("*").alias("_n"), F.max("retrieved_at").alias("retrieved_at"))
    best = counts.groupBy("company_orgnr").agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col("found_on_url"), F.col("retrieved_at"))).alias("_r")).select("company_orgnr", "_r.found_on_url", "_r.retrieved_at")
    c = F.col
    return observation(best, "hiring", c("company_orgnr"), c("company_orgnr"), F.lit("company_website"), "hiring_signal", c("found_on_url"), c("retrieved_at"), F.lit(None).cast("string"), {"page": c("found_on_url")})


def from_module(evidence: DataFrame, field: str, platform: str, signal: str, paths: dict[str, str]) -> DataFrame:
    """One observation of each company from an official module: its newest available evidence."""
    newest = evidence.where((F.col("field") == field) & (F.col("state") == "available") & F.col("value").isNotNull()).groupBy("organisation_number")
    row = newest.agg(F.max_by(F.struct("evidence_id", "source_url", "retrieved_at", "content_sha256", "value"), F.struct("ingested_at", "evidence_id")).alias("_r")).select("organisation_number", "_r.*")
    c = F.col
    return observation(row, field, c("organisation_number"), c("organisation_number"), F.lit(platform), signal, c("source_url"), c("retrieved_at"), c("content_sha256"), {k: F.get_json_object("value", p) for k, p in paths.items()})


#: field of the evidence: platform, signal, metrics
MODULES = {
    "financials": ("official_accounts", "financial_statement", {"revenue": "$.revenue", "year": "$.year"}),
    "locations": ("official_registry", "subunit", {"count": "$.count"}),
    "roles": ("official_registry", "governance", {"count": "$.count"}),
    "group": ("official_registry", "group_structure", {"count": "$.count"}),
}


def registry_social(companies: DataFrame, hosts: dict[str, str] | None = None) -> DataFrame:
    """Companies whose registered address is a profile on a social platform."""
    rows = companies.withColumn("_s", social_profile(F.col("website"), hosts)).where("_s is not null")
    c = F.col
    return observation(rows, "registry-social", F.concat_ws("-", c("organisation_number"), c("_s.platform")), c("organisation_number"), c("_s.platform"), "profile_handle", c("_s.url"), F.lit(None).cast("string"), F.lit(None).cast("string"), {"url": c("_s.url")})


def social_profiles(links: DataFrame) -> DataFrame:
    """Profiles that a company's verified site links: organisation_number, platform, url, retrieved_at; of a platform the least address."""
    one = links.where("platform is not null and url is not null").groupBy("organisation_number", "platform").agg(F.min(F.struct("url", "retrieved_at")).alias("_r")).select("organisation_number", "platform", "_r.*")
    c = F.col
    return observation(one, "social", F.concat_ws("-", c("organisation_number"), c("platform")), c("organisation_number"), c("platform"), "profile_handle", c("url"), c("retrieved_at"), F.lit(None).cast("string"), {"url": c("url")})


def unite(adapters: Iterable[DataFrame]) -> DataFrame:
    """All observations in the order of their adapters, each id once."""
    return keep_first_of_union([df.select(*SCHEMA) for df in adapters], ["id"], [F.col("source_url"), F.col("retrieved_at")])
