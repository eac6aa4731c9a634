"""Lookups: as-of, nearest, layered, by alias, by tolerance, by ordinal, by overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor_of(x: Column, breaks: Sequence[float]) -> Column:
    """The greatest of some fixed breaks that is not above x, else the smallest; no join, and it stays in generated code."""
    out = F.lit(float(min(breaks)))
    for b in sorted(breaks)[1:]:
        out = F.when(x >= b, float(b)).otherwise(out)
    return out


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, order: Sequence[str], value: Sequence[str]) -> DataFrame:
    """For each left row the values of the last right row of its key that is not after it.

    Both sides are sorted together once for each key: no row meets another, so the cost is that of one shuffle. `order`
    breaks ties among right rows. The columns of `left` must differ from `value`.
    """
    keep = [c for c in left.columns if c not in by]
    one = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(_struct(right, order)).alias("_order"), F.struct(*keep).alias("_row"), F.lit(None).cast(_struct(right, value)).alias("_value"))
    two = right.select(*by, F.col(on).alias("_at"), F.lit(0).alias("_side"), F.struct(*order).alias("_order"), F.lit(None).cast(_struct(left, keep)).alias("_row"), F.struct(*value).alias("_value"))
    seen = F.last("_value", ignorenulls=True).over(W.partitionBy(*by).orderBy("_at", "_side", "_order"))
    got = one.unionByName(two).withColumn("_seen", seen).where("_side = 1")
    return got.select(*by, "_row.*", *(F.col(f"_seen.{c}").alias(c) for c in value))


def _struct(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType


def nearest(x: Column, choices: Sequence[float]) -> Column:
    """Of some fixed values the one that is nearest; of two the first."""
    return F.array_min(F.array(*(F.struct(F.abs(x - v).alias("d"), F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in enumerate(choices))))["v"]


def nested_floor(x: Column, rows: Sequence[tuple[float, float]]) -> Column:
    """Rate of the last row not above x; below the first row, that of the last row. Rows are in file order."""
    known = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(r)).alias("r")) for a, r in rows))
    below = F.filter(known, lambda e: e["a"] <= x)
    return F.when(F.size(below) > 0, F.element_at(F.array_sort(below), -1)["r"]).otherwise(F.lit(float(rows[-1][1])))


def layered(base: DataFrame, layers: Sequence[tuple[str, DataFrame, str, str]], default: Column) -> DataFrame:
    """The first layer that has a value: (name, frame, key, value). Adds `value` and `source`."""
    out, values, source = base, [], F.lit("default")
    for k, (_, frame, key, value) in enumerate(layers):
        out = out.join(frame.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left")
        values.append(F.col(f"_v{k}"))
    for k in reversed(range(len(layers))):
        source = F.when(F.col(f"_v{k}").isNotNull(), F.lit(layers[k][0])).otherwise(source)
    out = out.withColumn("value", F.coalesce(*values, default)).withColumn("source", source)
    return out.drop(*(f"_{x}{k}" for k in range(len(layers)) for x in "kv"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in order, by partial minima: a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*(o.alias(f"_o{k}") for k, o in enumerate(order)), F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._row.*")


def alias_match(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Each probe row (key, aliases) with the build key that its earliest alias meets; of builds the smallest key."""
    known = build.select(F.explode("aliases").alias("alias"), build_key).groupBy("alias").agg(F.min(build_key).alias("hit"))
    asked = probe.select(probe_key, F.posexplode("aliases").alias("at", "alias"))
    return asked.join(known, "alias", "left").groupBy(probe_key).agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("at", "hit")))["hit"].alias("hit"))


def overlapping(df: DataFrame, by: str, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of half-open intervals of one key that overlap, by cells of a fixed width.

    A pair is told only in the cell where the later of the two begins, so none is told twice.
    """
    cells = df.select(by, key, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("cell"))
    one = cells.select(by, "cell", *(F.col(c).alias(f"a_{c}") for c in (key, start, end)))
    two = cells.select(by, "cell", *(F.col(c).alias(f"b_{c}") for c in (key, start, end)))
    meet = (F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col(f"a_{start}") < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(f"a_{end}"))
    once = F.floor(F.greatest(f"a_{start}", f"b_{start}") / width) == F.col("cell")
    return one.join(two, [by, "cell"]).where(meet & once).select(by, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))
