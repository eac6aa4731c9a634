"""Grids of tables: words in cells, cells merged where no line parts them, rows at an even pitch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components


def _tiles(low: str, high: str, side: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))


def words_in_cells(words: DataFrame, cells: DataFrame, page: str, word: str, cell: str, share: float, side: int) -> DataFrame:
    """(word, cell): of the cells that cover at least `share` of a word the one that covers most, then the smallest; else null.

    Both have x0, y0, x1, y1. They meet by tiles of a page, whose side should be about that of a cell. A pair that meets in
    several tiles counts once, as only the best is kept.
    """
    box = ["x0", "y0", "x1", "y1"]
    tiled = lambda df: df.withColumn("_tx", _tiles("x0", "x1", side)).withColumn("_ty", _tiles("y0", "y1", side))
    one = tiled(words.select(page, word, *box))
    two = tiled(cells.select(page, cell, *box)).select(page, cell, "_tx", "_ty", *(F.col(c).alias(f"c_{c}") for c in box))
    wide = F.least("x1", "c_x1") - F.greatest("x0", "c_x0")
    high = F.least("y1", "c_y1") - F.greatest("y0", "c_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    common = F.when((wide > 0) & (high > 0), wide * high).otherwise(0)
    met = one.join(two, [page, "_tx", "_ty"]).withColumn("_common", common).where((F.col("_common") > 0) & (F.col("_common") >= share * area))
    best = met.groupBy(word).agg(F.min(F.struct((-F.col("_common")).alias("c"), F.col(cell).alias("k")))["k"].alias(cell))
    return words.select(word).join(best, word, "left")


def merged_cells(nodes: DataFrame, open_sides: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """Cells joined where the side between them is open, but only to rectangles; other shapes fall back to single cells.

    `nodes` has the node, `keys`, r and c; `open_sides` has a and b. Gives keys, r, c, rows, columns.
    """
    of = nodes.join(components(nodes, open_sides, node), node)
    spans = of.groupBy(*keys, "component").agg(F.min("r").alias("r"), F.min("c").alias("c"), (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"), F.count(F.lit(1)).alias("n"))
    whole = F.col("n") == F.col("rows") * F.col("columns")
    single = of.join(spans.where(~whole).select("component"), "component", "left_semi").select(*keys, "r", "c", F.lit(1).alias("rows"), F.lit(1).alias("columns"))
    return spans.where(whole).select(*keys, "r", "c", "rows", "columns").unionByName(single)


def at_even_pitch(df: DataFrame, by: Sequence[str], y: str, tolerance: float = 2.0, least: int = 4) -> DataFrame:
    """Lines of a key, and those put in where a gap is a multiple of the most frequent one, of equals the smaller.

    The pitch counts from `least` gaps on. It is found by partial counts; the table of pitches has one row for each key.
    """
    rows = df.select(*by, y, (F.lead(y).over(W.partitionBy(*by).orderBy(y)) - F.col(y)).alias("_gap")).withColumn("_g", F.round("_gap", 1))
    counted = rows.where("_g is not null").groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("_n"))
    pitch = counted.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("_g")).alias("_s"))).alias("_p")).where((F.col("_p._n") >= least) & (F.col("_p._s") < 0)).select(*by, (-F.col("_p._s")).alias("_pitch"))
    times = F.rint(F.col("_gap") / F.col("_pitch"))
    fits = F.coalesce((times >= 2) & (F.abs(F.col("_gap") - times * F.col("_pitch")) <= tolerance), F.lit(False))
    rows = rows.join(pitch, list(by), "left").withColumn("_k", F.when(fits, times).otherwise(1.0).cast("int"))
    return rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(*by, F.when(F.col("_j") == 0, F.col(y)).otherwise(F.col(y) + F.col("_j") * F.col("_gap") / F.col("_k")).alias(y))
