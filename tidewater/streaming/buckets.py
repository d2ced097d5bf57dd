"""Time buckets over streams: the batch operators' counterparts, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, width: str, late: str, aggs: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Aggregates by tumbling buckets; rows later than `late` are left out, and a bucket's state goes once it's past."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(*(keys or []), F.window(ts, width).alias("w_")).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(*(keys or []), F.col("w_.start").alias(ts), *aggs)


def deduplicated(stream: DataFrame, ts: str, key: list[str], late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
