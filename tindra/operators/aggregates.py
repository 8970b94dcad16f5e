"""Aggregates over evidence: footprints, shared items, coverage, percentiles, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.session import checkpoint


def footprint(df: DataFrame, key: str, platform: str, url: str, accepted: Column, retrieved: Column, as_of: Column, fresh_days: int = 45) -> DataFrame:
    """One row for each key: rows accepted and rejected, platforms, distinct addresses, and how many were fresh at ``as_of``.

    Fresh is between 0 and ``fresh_days`` days old; a time after ``as_of`` is not.
    """
    age = F.unix_timestamp(as_of) - F.unix_timestamp(retrieved)
    ok = F.coalesce(accepted, F.lit(False))
    return df.groupBy(key).agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col(platform)))), ",").alias("platforms"),
        F.countDistinct(F.when(ok, F.col(url))).alias("distinct_urls"),
        F.count_if(ok & (age >= 0) & (age <= fresh_days * 86_400)).alias("fresh"),
    )


def gated_score(df: DataFrame, key: str, label: str, weights: dict[str, int], author: str, least_items: int = 10, least_authors: int = 2) -> DataFrame:
    """(key, items, authors, score): 50 + 50 x mean weight of the labels, to one decimal, half to even.

    Null unless there are enough items by enough authors; labels without weight count
    as items but not in the mean.
    """
    weight = F.lit(None).cast("int")
    for name, w in weights.items():
        weight = F.when(F.col(label) == name, w).otherwise(weight)
    sums = df.groupBy(key).agg(F.count(label).alias("items"), F.countDistinct(author).alias("authors"), F.avg(weight).alias("_mean"))
    return sums.select(key, "items", "authors", F.when((F.col("items") >= least_items) & (F.col("authors") >= least_authors), F.bround(50 + 50 * F.col("_mean"), 1)).alias("score"))


def owners(df: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owners): how many distinct owners each item has; null items are left out."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.countDistinct(owner).alias("owners"))


def withhold_shared(df: DataFrame, item: str, owner: str) -> DataFrame:
    """The rows whose item has a single owner; rows without item stay."""
    shared = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_a <> _b").select(item)
    return df.join(shared, item, "left_anti")


def state_table(df: DataFrame, row: str, status: str, states: tuple[str, ...]) -> DataFrame:
    """Counts of each state by row, one column a state."""
    return df.groupBy(row).agg(*(F.count_if(F.col(status) == s).alias(s) for s in states))


def order_statistics(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group..., n, names...): for each share p the value at place floor(n p), counted from 0, of the group's values in order.

    Nulls are left out.  Places are found from counts of distinct values that lie in
    ranges over all tasks, so a group of any size is spread; the ranges are checkpointed.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranged = checkpoint(counts.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range")  # a row for each range of a group
    before = sizes.select(*group, "_range", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("n"))
    inner = F.sum("_c").over(Window.partitionBy(*group, "_range").orderBy(value))
    joined = ranged.withColumn("_inner", inner).join(before, [*group, "_range"]).withColumn("_through", F.col("_before") + F.col("_inner"))
    place = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return joined.groupBy(*group).agg(F.first("n").alias("n"), *(F.min(F.when(F.col("_through") > place(p), F.col(value))).alias(name) for name, p in shares.items()))


def rates(df: DataFrame, group: str, found: Column, truth: Column) -> DataFrame:
    """(group, true_positive, false_positive, false_negative, precision, recall); a ratio over nothing is 1."""
    f, t = F.coalesce(found, F.lit(False)), F.coalesce(truth, F.lit(False))
    sums = df.groupBy(group).agg(F.count_if(f & t).alias("true_positive"), F.count_if(f & ~t).alias("false_positive"), F.count_if(~f & t).alias("false_negative"))
    ratio = lambda other: F.when(F.col("true_positive") + F.col(other) == 0, 1.0).otherwise(F.col("true_positive") / (F.col("true_positive") + F.col(other)))
    return sums.withColumn("precision", ratio("false_positive")).withColumn("recall", ratio("false_negative"))


def validate(df: DataFrame, key: str, status: str, states: tuple[str, ...], expected: int | None = None) -> DataFrame:
    """One row: rows, distinct keys, rows without key, rows in no known state, and whether all is as it should be."""
    row = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(key).alias("keys"),
        F.count_if(F.col(key).isNull()).alias("without_key"),
        F.count_if(~F.coalesce(F.col(status).isin(*states), F.lit(False))).alias("unknown_states"),
    )
    right = (F.col("rows") == F.col("keys")) & (F.col("without_key") == 0) & (F.col("unknown_states") == 0)
    return row.withColumn("valid", right & (F.col("rows") == expected) if expected is not None else right)


def by_platform(df: DataFrame, key: str, platform: str, url: str, accepted: Column, retrieved: Column, as_of: Column, fresh_days: int = 45) -> DataFrame:
    """(key, platform, items, distinct_urls, accepted, fresh): the footprint of each key on each platform."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(retrieved)
    fresh = F.coalesce((age >= 0) & (age <= fresh_days * 86_400), F.lit(False))
    return df.groupBy(key, F.col(platform).alias("platform")).agg(F.count("*").alias("items"), F.countDistinct(url).alias("distinct_urls"), F.count_if(F.coalesce(accepted, F.lit(False))).alias("accepted"), F.count_if(fresh).alias("fresh"))


def label_counts(df: DataFrame, key: str, label: str, names: dict[str, str], engagement: Column) -> DataFrame:
    """(key, <name>..., engagement): how often each label stands, and the sum of what was counted; null counts as 0."""
    return df.groupBy(key).agg(*(F.count_if(F.col(label) == value).alias(name) for name, value in names.items()), F.sum(F.coalesce(engagement, F.lit(0))).alias("engagement"))


def coverage(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(what, companies, items): of each frame the distinct keys and the rows."""
    parts = [df.agg(F.lit(name).alias("what"), F.countDistinct(key).alias("companies"), F.count("*").alias("items")) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
