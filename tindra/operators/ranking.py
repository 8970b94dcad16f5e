"""First-of-key, newest-of-key and turn-taking selections as windows.

Windows that keep the first few rows of a key are written as ``row_number() <= n`` so
that Spark limits the groups before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tindra.session import checkpoint


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null or empty key are dropped."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_first_of_union(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Sources united in order of preference; of each key the row of the first source that has it."""
    united = None
    for place, df in enumerate(frames):
        part = df.withColumn("_source", F.lit(place))
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    return keep_first(united, keys, [F.col("_source"), *order]).drop("_source")


def newest(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their ``place``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def without_bursts(df: DataFrame, key: list[str], weak: Column, at_least: int = 3) -> DataFrame:
    """Drops the weak rows of groups with ``at_least`` rows; the groups are counted before.

    The counts are aggregated and joined rather than windowed, so a group of any size
    is fine.
    """
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = df.alias("l").join(counts.alias("r"), condition)
    return joined.select("l.*", F.col("r._n").alias("_n")).where(~F.coalesce((F.col("_n") >= at_least) & weak, F.lit(False))).drop("_n")


def round_robin(df: DataFrame, key: str, section: str, order: list[Column], newest_of: str, n: int) -> DataFrame:
    """``n`` rows of each key, sections taking turns; sections come by their newest row, then by name.  Adds ``place``."""
    tops = df.groupBy(key, section).agg(F.max(newest_of).alias("_top"))
    ranked = tops.withColumn("_section", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("_top"), section))).drop("_top")
    # At most n rows of a section can be chosen, and only of its first n sections.
    inner = df.withColumn("place", F.row_number().over(Window.partitionBy(key, section).orderBy(*order))).where(F.col("place") <= n)
    joined = inner.join(ranked.where(F.col("_section") <= n), [key, section])
    w = Window.partitionBy(key).orderBy("place", "_section")
    return joined.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).drop("_section", "place").withColumnRenamed("turn", "place")


def quota_then_rest(df: DataFrame, key: str, kind: str, order: list[Column], quota: int, n: int) -> DataFrame:
    """``n`` rows of each key: first up to ``quota`` of each kind, in turns, then the others in order.  Adds ``place``."""
    own = Window.partitionBy(key, kind).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= n)
    over = F.when(F.col("_rn") <= quota, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(over, F.when(over == 0, F.col("_rn")).otherwise(0), *order)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("_rn")


def either_key(df: DataFrame, group: str, first: str, second: str, order: list[str]) -> DataFrame:
    """Of each group the rows, in order, of which neither key was seen in a row that was kept.

    What is kept depends on what was kept before.  A row that comes first among the open
    rows of both of its keys is kept whatever becomes of the others, and every open row
    that shares a key with it falls; so rounds of two aggregations decide all groups at
    once and no group is ever in one task.  Each round is checkpointed, and every round
    decides at least the first open row of each group.

    A null key is never seen before; a row whose keys are both null is kept.  Of copies
    with both keys the same the first in ``order`` takes part.
    """
    alone = df.where(F.col(first).isNull() & F.col(second).isNull())
    rest = [c for c in df.columns if c not in (group, first, second)]
    once = df.where(F.col(first).isNotNull() | F.col(second).isNotNull()).groupBy(group, first, second).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    open_rows = checkpoint(once.select(F.col(group).alias("_g"), F.col(first).alias("_a"), F.col(second).alias("_b"), F.struct(*(F.col(f"_r.{c}") for c in order), first, second).alias("_at"), "_r"))
    decided = []

    def leads(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy("_g", key).agg(F.min("_at").alias(name))

    def on(rows: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
        side = side.withColumnsRenamed({"_g": "_g2", key: "_k2"})
        return rows.join(side, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col(key) == F.col("_k2")), how).drop("_g2", "_k2")

    while not open_rows.isEmpty():
        marked = on(on(open_rows, leads(open_rows, "_a", "_ma"), "_a", "left"), leads(open_rows, "_b", "_mb"), "_b", "left")
        is_first = lambda m: F.coalesce(F.col("_at") == F.col(m), F.lit(True))
        marked = checkpoint(marked.withColumn("_keep", is_first("_ma") & is_first("_mb")).drop("_ma", "_mb"))
        kept = marked.where("_keep").drop("_keep")
        decided.append(kept)
        open_rows = marked.where("not _keep").drop("_keep")
        for key in ("_a", "_b"):
            open_rows = on(open_rows, kept.where(F.col(key).isNotNull()).select("_g", key).distinct(), key, "left_anti")
        open_rows = checkpoint(open_rows)
    back = [d.select(F.col("_g").alias(group), F.col("_a").alias(first), F.col("_b").alias(second), *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns) for d in decided]
    return reduce(DataFrame.unionByName, back, alone)


def best_of(df: DataFrame, key: list[str], score: Column, tie: list[Column]) -> DataFrame:
    """The row of each key with the greatest score; of equal scores the first in ``tie``.  Null scores come last.

    An aggregate with one row of state, so a key of any size is fine.
    """
    rest = [c for c in df.columns if c not in key]
    # The least of (negated rank, tie) is found by min_by over a struct.
    order = F.struct(F.when(score.isNull(), 1).otherwise(0), (-score).alias("s"), *tie)
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
