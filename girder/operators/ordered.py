"""Operators over ordered rows. All windows are partitioned, by document, table or user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def before(by: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def up_to(by: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def after(by: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)


def segment(flag: Column, by: Sequence[str], order: Sequence[str], closes: bool = True) -> Column:
    """Number of the stretch a row is in. A flagged row ends its stretch, or begins one."""
    return F.coalesce(F.sum(flag.cast("int")).over((before if closes else up_to)(by, order)), F.lit(0))


def group_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], kind: str, value: str, tolerance: Column) -> DataFrame:
    """Printed totals against sums, on two levels.

    `kind` is data, group_total or profile_total. A group total is held against the data rows since the total before;
    a profile total against group totals since the profile total before, and data rows that no group total closed.
    """
    is_group, is_profile, is_data = (F.col(kind) == k for k in ("group_total", "profile_total", "data"))
    rows = df.withColumn("_g", segment(is_group | is_profile, by, order)).withColumn("_p", segment(is_profile, by, order))
    data = F.sum(F.when(is_data, F.col(value))).over(W.partitionBy(*by, "_g"))
    closed = F.max(is_group.cast("int")).over(W.partitionBy(*by, "_g"))
    rows = rows.withColumn("_data", F.coalesce(data, F.lit(0.0))).withColumn("_closed", closed)
    part = F.when(is_group, F.col(value)).when(is_data & (F.col("_closed") == 0), F.col(value))
    profile = F.coalesce(F.sum(part).over(W.partitionBy(*by, "_p")), F.lit(0.0))
    rows = rows.withColumn("calculated", F.when(is_group, F.col("_data")).when(is_profile, profile))
    status = F.when(F.col(value).isNull(), "skipped").when(F.abs(F.col("calculated") - F.col(value)) <= tolerance, "ok").otherwise("failed")
    return rows.where(is_group | is_profile).withColumn("status", status).drop("_g", "_p", "_data", "_closed")


def carried(value: Column, reset: Column, by: Sequence[str], order: Sequence[str], df: DataFrame, name: str) -> DataFrame:
    """The last value seen since the last reset; a reset row carries nothing."""
    rows = df.withColumn("_s", segment(reset, by, order, closes=False)).withColumn("_v", F.when(~reset, value))
    got = F.last("_v", ignorenulls=True).over(up_to([*by, "_s"], order))
    return rows.withColumn(name, F.when(~reset, got)).drop("_s", "_v")


def gaps_filled(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Missing numbers, where both neighbours prove the length of the run between them."""
    rows = df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("_n").alias("n")))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(up_to(by, order))).withColumn("_b", F.first(known, ignorenulls=True).over(after(by, order)))
    proven = (F.col("_b.v") - F.col("_a.v")) == (F.col("_b.n") - F.col("_a.n"))
    return rows.withColumn(name, F.coalesce(F.col(value), F.when(proven, F.col("_a.v") + F.col("_n") - F.col("_a.n")))).drop("_n", "_a", "_b")


def neighbours_agree(value: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """value, but the number between its neighbours where they leave room for one only."""
    w = W.partitionBy(*by).orderBy(*order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    return F.when((prev + 1 == nxt - 1) & (value != prev + 1), prev + 1).otherwise(value)


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals of a key joined where they overlap or lie within `gap`: start, end and number."""
    order = [start, end]
    far = F.max(end).over(before(by, order))
    rows = df.withColumn("_new", (far.isNull() | (F.col(start) > far + gap)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(up_to(by, order)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def clusters(df: DataFrame, by: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Values of a key parted where the step from one to the next is above the tolerance: mean and number.

    Missing values come last and count in the last cluster. Both windows are over one sort, so that of equal values the
    one that begins a cluster comes first and none stays behind; values are summed in their order.
    """
    w = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    rows = df.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "cluster").agg(F.avg(value).alias("center"), F.count(F.lit(1)).alias("n"))


def far_from_last_kept(sorted_values: Column, least: float) -> Column:
    """Of a sorted array the values that are at least so far from the last one kept."""
    start = F.slice(sorted_values, 1, 1)
    return F.aggregate(sorted_values, start, lambda kept, v: F.when(v >= F.element_at(kept, -1) + least, F.concat(kept, F.array(v))).otherwise(kept))
