"""Snapshots and evidence as streams.

The batch operators compare whole deliveries; these follow a folder or topic to which
rows are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def once_each(stream: DataFrame, key: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """Rows without redeliveries that come within ``delay``; the state forgets keys after that."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def counts_by_window(stream: DataFrame, time: str, group: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(start, group, rows) by window of time; rows later than ``delay`` are left out."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("rows"))
    return counted.select(F.col("w.start").alias("start"), group, "rows")


def state_changes(stream: DataFrame, key: str, status: str, time: str) -> DataFrame:
    """(key, before, after, at) whenever a key's status differs from the last one by time; rows older than the state are ignored.

    The state of a key is its last status and time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def follow(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for row in rows.itertuples():
            if at is not None and row.at < at:
                continue
            if row.status != last:
                out.append((keys[0], last, row.status, row.at))
            last, at = row.status, row.at
        state.update((last, at))
        yield pd.DataFrame(out, columns=["key", "before", "after", "at"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(status).cast("string").alias("status"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")).where("key is not null and at is not null")
    return rows.groupBy("key").applyInPandasWithState(follow, "key string, before string, after string, at bigint", "status string, at bigint", "append", GroupStateTimeout.NoTimeout)
