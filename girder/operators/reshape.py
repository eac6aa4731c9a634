"""Reshaping: unpivot, pivot to roles, spans, nested requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, keys: Sequence[str], masses: Column, total: Column) -> DataFrame:
    """One row for each positive entry of a map; without any, one row with the total."""
    positive = F.map_filter(masses, lambda k, v: v > 0)
    rows = F.when(F.size(positive) > 0, positive).otherwise(F.create_map(F.lit("total"), total))
    return df.select(*keys, F.explode(rows).alias("element", "mass"))


def roles(cells: DataFrame, row_keys: Sequence[str], role: str, value: str, known: Sequence[str]) -> DataFrame:
    """Cells to one row for each logical row, a column for each known role."""
    return cells.groupBy(*row_keys).pivot(role, list(known)).agg(F.first(value, ignorenulls=True))


def covered(cells: DataFrame, row: str, col: str, row_span: str, col_span: str) -> DataFrame:
    """A merged cell repeated at every place it covers."""
    down = cells.withColumn("r", F.explode(F.sequence(F.col(row), F.col(row) + F.col(row_span) - 1)))
    return down.withColumn("c", F.explode(F.sequence(F.col(col), F.col(col) + F.col(col_span) - 1)))


def flattened(requests: DataFrame, request: str) -> DataFrame:
    """groups -> elements, with generated ids (g1, g1-e1) and the group's quantity; a quantity not above 0 counts as 1."""
    one = F.posexplode("groups").alias("gi", "g")
    groups = requests.select(request, one)
    each = groups.select(request, "gi", F.col("g.quantity").alias("gq"), F.posexplode("g.elements").alias("ei", "e"))
    positive = lambda c: F.when(c > 0, c).otherwise(1.0)
    group_id = F.concat(F.lit("g"), (F.col("gi") + 1).cast("string"))
    return each.select(request, group_id.alias("group_id"), F.concat(group_id, F.lit("-e"), (F.col("ei") + 1).cast("string")).alias("element_id"), "e.*", (positive(F.col("gq")) * positive(F.col("e.quantity"))).alias("multiplier")).drop("quantity")
