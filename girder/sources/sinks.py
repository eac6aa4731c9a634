"""Writing results: appends, upserts, JSON for each table, delimited grids, sheets with totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control characters that spreadsheets refuse.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def append(df: DataFrame, path: str) -> None:
    """Nothing is written for no rows, so that no empty commit appears."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def upserted(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `rows` in place of those of equal key, nulls in keys being equal."""
    same = [base[k].eqNullSafe(rows[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return base.join(rows, on, "left_anti").unionByName(rows)


def json_tables(df: DataFrame, table: str, order: Sequence[str], fields: Sequence[str], path: str) -> None:
    """One JSON line for each table, its rows in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("row")))), lambda x: x["row"])
    df.groupBy(table).agg(rows.alias("rows")).write.mode("overwrite").json(path)


def grid(df: DataFrame, path: str, separator: str = ";") -> None:
    text = [F.regexp_replace(F.col(c).cast("string"), CONTROL, "").alias(c) for c in df.columns]
    df.select(*text).write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def sheets(lines: DataFrame, sheet: str, item: str, quantity: str) -> DataFrame:
    """Lines with a total for each sheet and one for all; `level` is 0 for lines, 1 for sheets, 3 for all."""
    return lines.rollup(sheet, item).agg(F.sum(F.col(quantity).cast("decimal(18,3)")).alias(quantity), F.grouping_id().cast("int").alias("level"))
