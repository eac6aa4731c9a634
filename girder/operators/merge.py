"""Merging versions of a catalog, and removing duplicates by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import first_by


def by_priority(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: highest priority, then the other orders, then the first."""
    return first_by(df, keys, order)


def keyed_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], source: str, order: str) -> DataFrame:
    """Old rows keep their order; a new row replaces one of the same source only, and unknown keys come at the end."""
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in (*values, source, order)))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in (*values, source, order)))
    both = o.join(n, list(keys), "full_outer")
    known, replaces = F.col(f"o_{source}").isNotNull(), F.col(f"o_{source}") == F.col(f"n_{source}")
    take = lambda c: F.when(~known | F.coalesce(replaces, F.lit(False)), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    state = F.when(~known, "inserted").when(F.coalesce(replaces, F.lit(False)), "updated").otherwise("kept")
    return both.select(*keys, *(take(c) for c in (*values, source)), state.alias("state"), (~known).cast("int").alias("block"), F.coalesce(f"o_{order}", f"n_{order}").alias(order))


def patched(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of base with the patch's values where it has any."""
    p = patch.select(key, *(F.col(c).alias(f"p_{c}") for c in columns))
    return base.join(p, key, "left").select(*(F.coalesce(f"p_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def shadowed(top: DataFrame, under: DataFrame, key: str) -> DataFrame:
    """All of the top, and what it does not have from under it."""
    return top.unionByName(under.join(top.select(key), key, "left_anti"))


def grouped_by_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Groups by key with the place where each first appears; blank keys have no group."""
    return df.select(key.alias("key"), order).where("key <> ''").groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
