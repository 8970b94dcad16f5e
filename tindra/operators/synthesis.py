"""Facts, gaps and signals of companies, put together from evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The modules that a company is described by, in the order in which gaps are told.
MODULES = ("registry", "registry_live", "financials", "roles", "group", "locations", "website", "accounting_obligation", "external_footprint")
# Words of a question and the modules that answer it.
TOPICS = {
    "registry": ("employee", "industry", "activity", "registry", "address", "founded", "registered"),
    "accounting_obligation": ("account", "obligation", "audit"),
    "financials": ("revenue", "profit", "result", "turnover", "assets", "equity", "debt", "financial"),
    "roles": ("lead", "role", "chair", "ceo", "board"),
    "locations": ("location", "where", "branch"),
    "website": ("website", "social", "homepage"),
    "group": ("group", "parent", "owner", "subsidiary"),
}
#: Subjects that no evidence answers.
UNANSWERED = ("sentiment", "salary", "culture")


def facts(evidence: DataFrame, paths: dict[str, list[str]]) -> DataFrame:
    """(organisation_number, module, claim, value, source_url, retrieved_at, content_sha256): one row for each value found.

    ``paths`` names the JSON fields of each module.  Facts without address, time or hash
    are left out, as are those of evidence that is not available.
    """
    entries = F.map_from_arrays(F.array(*(F.lit(m) for m in paths)), F.array(*(F.array(*(F.lit(p) for p in fields)) for fields in paths.values())))
    known = evidence.where((F.col("state") == "available") & F.col("source_url").isNotNull() & F.col("retrieved_at").isNotNull() & F.col("content_sha256").isNotNull())
    rows = known.withColumn("claim", F.explode(F.element_at(entries, F.col("field"))))
    value = F.lit(None).cast("string")
    for p in sorted({p for fields in paths.values() for p in fields}):
        value = F.when(F.col("claim") == p, F.get_json_object("value", f"$.{p}")).otherwise(value)
    picked = rows.select("organisation_number", F.col("field").alias("module"), "claim", value.alias("value"), "source_url", "retrieved_at", "content_sha256")
    return picked.where("value is not null").distinct()


def topics_of(question: str) -> list[str] | None:
    """The modules that a question is about, all of them where it names none; None where no evidence answers it."""
    lower = question.casefold()
    if any(word in lower for word in UNANSWERED):
        return None
    found = [module for module, words in TOPICS.items() if any(w in lower for w in words)]
    return found or list(TOPICS)


def answer(all_facts: DataFrame, question: str) -> DataFrame:
    """The facts on a question; none where no evidence answers it."""
    topics = topics_of(question)
    return all_facts.limit(0) if topics is None else all_facts.where(F.col("module").isin(*topics))


def unknowns(companies: DataFrame, evidence: DataFrame, key: str = "organisation_number", modules: tuple[str, ...] = MODULES) -> DataFrame:
    """(key, module, state) of each module that is not available for a company; ``missing`` where there is no evidence at all.

    Of several rows of a module the best state counts.
    """
    best = evidence.groupBy(key, F.col("field").alias("module")).agg(F.max(F.col("state") == "available").alias("_ok"), F.min("state").alias("_state"))
    wanted = companies.select(key).distinct().select(key, F.explode(F.array(*(F.lit(m) for m in modules))).alias("module"))
    joined = wanted.join(best, [key, "module"], "left").where(~F.coalesce("_ok", F.lit(False)))
    return joined.select(key, "module", F.coalesce("_state", F.lit("missing")).alias("state"))


def signals(frames: dict[str, tuple[DataFrame, Column]], key: str = "organisation_number") -> DataFrame:
    """(key, signal, n): how many rows of each kind hold for a company; a company without any is left out."""
    parts = [df.where(F.coalesce(holds, F.lit(False))).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("signal"), "n") for name, (df, holds) in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def outlook(trends: DataFrame, change: str = "change_pct", threshold: float = 10.0) -> Column:
    """growing, contracting or steady by the change of a trend; null where there is none."""
    return F.when(F.col(change) >= threshold, "growing").when(F.col(change) <= -threshold, "contracting").when(F.col(change).isNotNull(), "steady")


def inferences(trends: DataFrame, postings: DataFrame, news: DataFrame, key: str = "organisation_number", threshold: float = 10.0) -> DataFrame:
    """(key, statement, basis): what follows from the signals of a company, kept apart from them; ``postings`` and ``news`` have counts ``n``."""
    said = lambda df, statement, basis: df.select(key, F.lit(statement).alias("statement"), F.lit(basis).alias("basis"))
    parts = [
        said(trends.where(F.col("change_pct") >= threshold), "growing", "revenue_trend"),
        said(trends.where(F.col("change_pct") <= -threshold), "contracting", "revenue_trend"),
        said(postings.where("n > 0"), "recruiting", "job_postings"),
        said(news.where("n >= 2"), "publishing", "recent_news"),
    ]
    return reduce(DataFrame.unionByName, parts)
