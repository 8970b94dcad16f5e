"""Queries of the text and matching problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tindra.llm import addresses, boilerplate, canonical, encoding, entities, mixing, mojibake
from tindra.tables import load


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, record_id, original, restored, mappings, restorable) of each garbled title."""
    titles = (("jobs", "job_id", "job_title"), ("activities", "activity_id", "title"))
    tables = {name: load(spark, folder, name) for name, _, _ in titles}
    model = mojibake.fit([tables[name].select(c) for name, _, text in titles for c in (text, "description")])
    parts = [mojibake.find_garbled(tables[name], key, text, model).withColumnRenamed(key, "record_id").select(F.lit(name).alias("source_table"), "*") for name, key, text in titles]
    return parts[0].unionByName(parts[1]).dropDuplicates(["source_table", "record_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_restored(spark, folder).select("source_table", "record_id")


def p2_content(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, record_id, field, line_no, line) of every line with main content."""
    pages, activities = load(spark, folder, "fetch_results"), load(spark, folder, "activities")
    models = boilerplate.train(boilerplate.training_pages(pages, "fetch_id", "url", "body"))
    parts = [
        boilerplate.extract(df, key, field, kind, models, url).select(F.lit(table).alias("source_table"), "record_id", F.lit(field).alias("field"), "line_no", "line")
        for df, table, key, field, kind, url in (
            (pages, "fetch_results", "fetch_id", "body", "page", "url"),
            (activities, "activities", "activity_id", "title", "title", None),
            (activities, "activities", "activity_id", "description", "lines", None),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_content(spark, folder).drop("line")


def _address_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, address, code, town, municipality) of the three address fields."""
    registry = load(spark, folder, "registry")
    business = registry.select(
        F.concat(F.lit("b:"), "organisation_number").alias("record_id"),
        F.col("business_address.adresse").alias("address"),
        F.col("business_address.postnummer").alias("code"),
        F.col("business_address.poststed").alias("town"),
        F.col("business_address.kommune").alias("municipality"),
    )
    postal = registry.select(
        F.concat(F.lit("p:"), "organisation_number").alias("record_id"),
        F.col("postal_address.adresse").alias("address"),
        F.col("postal_address.postnummer").alias("code"),
        F.col("postal_address.poststed").alias("town"),
        F.lit(None).cast("string").alias("municipality"),
    )
    none = F.lit(None).cast("string")
    jobs = load(spark, folder, "jobs").select(F.concat(F.lit("j:"), "job_id").alias("record_id"), F.col("location").alias("address"), none.alias("code"), none.alias("town"), none.alias("municipality"))
    return business.unionByName(postal).unionByName(jobs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_place_pairs(_address_records(spark, folder), load(spark, folder, "postal_places"))


def p5_places(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, place_id) of each record that names a place."""
    return addresses.places_of(_address_records(spark, folder), load(spark, folder, "postal_places"))


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, organisation_number, confidence) of each candidate's pairs that are likelier than not."""
    said = F.col("identity_evidence")
    pages = load(spark, folder, "candidates").select(
        F.col("candidate_id").alias("page"), "url", said["page_title"].alias("title"), said["place"].alias("place"), said["trade"].alias("trade"), said["staff_hint"].alias("staff")
    )
    companies = load(spark, folder, "fresh_companies").select(F.col("organisation_number").alias("company"), "name", "municipality", F.col("industry_label").alias("industry"), "employees")
    found = entities.match(pages, companies, load(spark, folder, "postal_places"))
    return found.where("confidence >= 0.5").select(F.col("page").alias("candidate_id"), F.col("company").alias("organisation_number"), "confidence")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_matches(spark, folder).select("candidate_id", "organisation_number")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(load(spark, folder, "documents"), "doc_id", "text")


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the ids of every document turned back; null and empty texts are both empty."""
    return encoding.decode(p7_ids(spark, folder), "doc_id", "ids")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source with a target whether the mix keeps its repeats, uses no more than there is, and is within 0.02 of its share (where there is anything to use)."""
    rows = p8_shares(spark, folder).withColumn("reachable", F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).over(Window.partitionBy()))  # a row for each target
    near = F.abs(F.col("actual_share") - F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("reachable")).otherwise(0.0)) < 0.02
    within = (F.col("most_copies") <= F.col("max_repeats")) & (F.col("used_tokens") <= F.col("max_repeats") * F.col("available_tokens"))
    return rows.select("source", "documents", within.alias("within_repeats"), near.alias("near_target"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each source with a target: tokens available and used, and the share reached."""
    targets = load(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(load(spark, folder, "documents"), targets), targets)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document."""
    return mixing.mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets")).drop("p")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.look_alike_pairs(load(spark, folder, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_forms(load(spark, folder, "documents"), "doc_id", "text").select("doc_id", "form")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_content": p2_content, "p5_found": p5_found, "p5_places": p5_places, "p6_found": p6_found, "p6_matches": p6_matches, "p7_ids": p7_ids, "p7_text": p7_text, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found, "p9_forms": p9_forms}

SQL: dict[str, str] = {
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_kept": "SELECT t.source, count(d.doc_id) AS documents, true AS within_repeats, true AS near_target FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) t LEFT JOIN documents d USING (source) GROUP BY 1",
}
