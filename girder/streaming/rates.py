"""Rates, quantiles, changes and staleness over events; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def share(events: DataFrame, flag: Column, length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Flagged share of the events of each sliding window."""
    by = events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))
    return by.select(F.col("w.start").alias("start"), "n", "flagged", (F.col("flagged") / F.col("n")).alias("share"))


def quantile(events: DataFrame, keys: list[str], value: str, p: float, length: str, accuracy: int | None = 10_000) -> DataFrame:
    """A quantile of each key's windows, with the rank off by one part in `accuracy` at most: what a window holds is bounded by it.

    Without an accuracy it is exact and interpolated, and a window holds each of its distinct values.
    """
    q = F.percentile(value, F.lit(p)) if accuracy is None else F.percentile_approx(value, p, accuracy)
    by = events.groupBy(*keys, F.window("ts", length).alias("w")).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    return by.select(*keys, F.col("w.start").alias("start"), "q", "n")


def changes(events: DataFrame, key: str, value: str, order: str, length: str) -> DataFrame:
    """How often the value of a key changes from one event to the next, by window of the later event."""
    before = F.lag(value).over(W.partitionBy(key).orderBy("ts", order))
    rows = events.withColumn("_changed", before.isNotNull() & (before != F.col(value)))
    return rows.groupBy(key, F.window("ts", length).alias("w")).agg(F.count_if("_changed").alias("changes")).select(key, F.col("w.start").alias("start"), "changes")


def staleness(events: DataFrame, key: str, now: Column) -> DataFrame:
    return events.groupBy(key).agg(F.max("ts").alias("last")).select(key, "last", (F.unix_timestamp(now) - F.unix_timestamp("last")).alias("age"))


def stream(spark: SparkSession, folder: str, schema: StructType, flag: Column, name: str, late: str = "10 minutes") -> StreamingQuery:
    """The share as a stream over a folder of Parquet files, into a table in memory; late events count up to the watermark."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return share(events, flag).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
