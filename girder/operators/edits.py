"""Edits of groups of rows: moves, removals, splits and merges of lists; gates, labels and choices of recognised rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- fixed values: statuses that count, fire limits, labels of constructions, marks of a recovered grade
COUNTED = ("Посчитано", "Требует проверки")
OPEN_STATUS = ("Нужен ввод массы", "Нет данных")
FIRE_LIMITS = ("R15", "R30", "R45", "R60", "R90", "R120", "R150", "R180", "R210", "R240")
CONSTRUCTIONS = (("Колонны/Стойки", "колонна / стойка"), ("Балки", "балка"), ("Связи", "связь"), ("Прогоны", "прогон"), ("Ригели", "ригели"))
LOST_GRADES, GRADE = ("10°", "ШИ"), "70"
TOKEN = r"^n\d{13,17}$"

UNGROUPED = 0


def prefill_kind(status: Column, sheet: Column, length: Column, fire: Column) -> Column:
    """`sheet` or `item` for rows that go to the calculator, null for the others. A sheet needs neither length nor limit."""
    item = (length > 0) & (F.trim(F.coalesce(fire, F.lit(""))) != "")
    return F.when(~status.isin(*COUNTED), F.lit(None)).when(sheet, "sheet").when(item, "item")


def renumbered(df: DataFrame, doc: Sequence[str], block: str, order: Sequence[Column], ord_: str) -> DataFrame:
    return df.withColumn(ord_, F.row_number().over(W.partitionBy(*doc, block).orderBy(*order)))


def moved(df: DataFrame, doc: Sequence[str], block: str, ord_: str, asked: Column, target: int) -> DataFrame:
    """Asked rows go to the end of the target block, those of earlier blocks first; rows of the target stay where they are."""
    goes = asked & (F.col(block) != target)
    rows = df.withColumn("_last", goes.cast("int")).withColumn("_from", F.when(goes, F.col(block)).otherwise(0))
    rows = rows.withColumn(block, F.when(goes, F.lit(target)).otherwise(F.col(block)))
    return renumbered(rows, doc, block, [F.col("_last"), F.col("_from"), F.col(ord_)], ord_).drop("_last", "_from")


def without_block(df: DataFrame, doc: Sequence[str], block: str, ord_: str, gone: int) -> DataFrame:
    """The rows of a block go to the end of those without a block, and later blocks move up by one."""
    rows = moved(df, doc, block, ord_, F.col(block) == gone, UNGROUPED)
    return rows.withColumn(block, F.col(block) - (F.col(block) > gone).cast("int"))


def block_plan(rows: DataFrame, doc: Sequence[str], block: str, titles: DataFrame) -> DataFrame:
    """Blocks that have rows: those without a block first, untitled and once; others by their trimmed title and quantity, 1 at least of it."""
    counts = rows.groupBy(*doc, block).agg(F.count(F.lit(1)).alias("elements"))
    got = counts.join(titles, block, "left")
    alone = F.col(block) == UNGROUPED
    quantity = F.when(alone | (F.coalesce(F.col("quantity"), F.lit(0)) == 0), 1).otherwise(F.col("quantity"))
    return got.select(*doc, block, F.when(alone, "").otherwise(F.trim("title")).alias("title"), quantity.alias("quantity"), "elements")


def split_positions(df: DataFrame, positions: str, values: Sequence[str]) -> DataFrame:
    """A row for each position that shares a cell; the values stay with the first, and each part says why."""
    several = F.size(positions) > 1
    note = F.when(several, F.format_string("row not separated by a ruling line; %d positions share one cell", F.size(positions)))
    rest = [c for c in df.columns if c not in (positions, *values)]
    rows = df.select(*rest, *values, note.alias("note"), F.posexplode_outer(positions).alias("part", "position"))
    return rows.select(*rest, "position", *(F.when(F.coalesce(F.col("part"), F.lit(0)) == 0, F.col(v)).alias(v) for v in values), "note")


def column_key(role: Column, index: Column) -> Column:
    """Columns of elements go by index, as their titles may be misread; unknown ones too."""
    return F.when(role == "element_mass", F.concat(F.lit("element:"), index.cast("string"))).when(role == "unknown", F.concat(F.lit("col"), index.cast("string"))).otherwise(role)


def continued_groups(df: DataFrame, block: Sequence[str], group: str, order: Sequence[str], data: Column, position: str, text: str) -> DataFrame:
    """For each group of a block: whether it has the block's first data row with a position and its text begins in lower case."""
    counts = data & F.col(position).isNotNull()
    key = F.struct(*order)
    first = F.min_by(F.struct(F.col(group).alias("g"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("t")), F.when(counts, key)).alias("first")
    heads = df.groupBy(*block).agg(first)
    groups = df.select(*block, group).distinct()
    starts = F.col("first.t").rlike(r"^\p{Ll}")
    return groups.join(heads, list(block)).select(*block, group, F.coalesce((F.col("first.g") == F.col(group)) & starts, F.lit(False)).alias("continued"))


def share_token(href: Column) -> Column:
    """The token of a page's address: its whole query, or the query's first field n."""
    search = F.regexp_extract(href, r"\?([^#]*)", 1)
    named = F.regexp_extract(search, r"(?:^|&)n=([^&]*)", 1)
    return F.when(search.rlike(TOKEN), search).when(named.rlike(TOKEN), named)


def new_token(ms: Column, attempt: Column) -> Column:
    """n and milliseconds; three more digits from the second try on."""
    base = F.concat(F.lit("n"), ms.cast("string"))
    return F.when(attempt == 0, base).otherwise(F.concat(base, F.lpad((attempt % 1000).cast("string"), 3, "0")))


def section_area(shape: Column, dim) -> Column:
    """Area of a section with its fillets, mm²; null where dimensions are missing. `dim` gives a dimension by name, 0 where there is none."""
    fillet = lambda r, n: F.when(r > 0, n * (1 - math.pi / 4) * r * r).otherwise(0.0)
    h, b, s, t, big_r, r, big_b, big_a, d = (dim(k) for k in ("h", "b", "s", "t", "R", "r", "B", "A", "d"))
    beam = F.when((h > 0) & (b > 0) & (s > 0) & (t > 0), 2 * b * t + (h - 2 * t) * s + fillet(big_r, F.when(shape.startswith("I-beam"), 4).otherwise(2)))
    equal = F.when((b > 0) & (t > 0), (2 * b - t) * t + fillet(big_r, F.lit(1)) - fillet(r, F.lit(2)))
    unequal = F.when((big_b > 0) & (b > 0) & (t > 0), (big_b + b - t) * t)
    square = F.when((big_a > 0) & (s > 0) & (2 * s < big_a), 4 * (big_a - s) * s - (4 - math.pi) * 3 * s * s)
    hollow = F.when((h > 0) & (b > 0) & (t > 0), 2 * (h + b - 2 * t) * t - (4 - math.pi) * 3 * t * t)
    wall = F.when(h != 0, h).when(s != 0, s).otherwise(t)
    tube = F.when((d > 0) & (wall > 0) & (2 * wall < d), math.pi * (d - wall) * wall)
    return (
        F.when(shape.startswith("I-beam") | shape.startswith("channel"), beam).when(shape.isin("corner_e", "corner_"), equal).when(shape == "corner_ue", unequal)
        .when(shape == "tube_sq", square).when(shape.startswith("profile"), hollow).when(shape.isin("tube_sm", "tube_"), tube)
    )


def concrete_delta(limit: Column, by_limit: Column) -> Column:
    """Thickness by fire limit: the map's, 50 where it has none; without a map 40 from 240 on."""
    known = F.coalesce(F.try_element_at(by_limit, F.format_string("%.0f", limit)), F.lit(50.0))
    return F.when(by_limit.isNotNull(), known).otherwise(F.when(limit >= 240, 40.0).otherwise(50.0))


def alike(new: DataFrame, old: DataFrame, shape: str, dims: Sequence[str], tolerance: float) -> DataFrame:
    """Rows of `new` that have a row of one shape in `old` with each dimension within the tolerance.

    The first dimension is cut into steps of the tolerance, so that rows meet only near ones of their shape.
    """
    step = F.floor(F.col(dims[0]) / tolerance).cast("long")
    near = old.select(F.col(shape).alias("_shape"), F.explode(F.sequence(step - 1, step + 1)).alias("_step"), *(F.col(c).alias(f"_{c}") for c in dims))
    same = (F.col(shape) == F.col("_shape")) & (step == F.col("_step"))
    for c in dims:
        same = same & (F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance)
    return new.join(near, same, "left_semi")


def client_patch(df: DataFrame, mass: str, per_metre: Column, length: Column) -> DataFrame:
    """A mass per metre was typed in: the length follows where none was typed, and open rows are counted."""
    hit = (per_metre > 0) & length.isNull() & (F.col(mass) > 0)
    hit = F.coalesce(hit, F.lit(False))
    return (
        df.withColumn("length_m", F.when(hit, F.floor(F.col(mass) / per_metre * 100 + 0.5) / 100).otherwise(length))
        .withColumn("mass_source", F.when(hit, "manual").otherwise("handbook"))
        .withColumn("status", F.when(hit & F.col("status").isin(*OPEN_STATUS), COUNTED[0]).otherwise(F.col("status")))
    )


def recovered_grade(read: Column, source: Column, confidence: Column, text: Column, other: Column) -> Column:
    """The grade that the second reader is sure of, where the first was not and read one of the known wrong forms."""
    return F.when(source.isin("ocr", "glyph") & (confidence < 0.5) & F.trim(text).isin(*LOST_GRADES) & (F.trim(F.coalesce(other, F.lit(""))) == GRADE), GRADE).otherwise(read)


def choices(current: Column, canon: Sequence[str] = FIRE_LIMITS) -> Column:
    """The known values, after the current one if it is none of them."""
    known, now = F.array(*map(F.lit, canon)), F.trim(F.coalesce(current, F.lit("")))
    return F.when((now != "") & ~F.array_contains(known, now), F.concat(F.array(now), known)).otherwise(known)


def construction_label(construction: Column) -> Column:
    name = F.trim(F.coalesce(construction, F.lit("")))
    out = F.lower(name)
    for full, short in CONSTRUCTIONS:
        out = F.when(name == full, short).otherwise(out)
    return out


def element_name(construction: Column, mark: Column, fallback: str = "Элемент") -> Column:
    label, name = construction_label(construction), F.trim(F.coalesce(mark, F.lit("")))
    return F.when((label == "") & (name == ""), fallback).otherwise(F.concat_ws(" ", F.when(label != "", label), F.when(name != "", name)))


def counted_notes(counts: Sequence[tuple[Column, str]]) -> Column:
    """One sentence for each counter that is not zero."""
    return F.concat_ws("; ", *(F.when(n > 0, F.format_string(text, n)) for n, text in counts))


def chart_limit(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """`limit` of a plate at a value: the row of its thickness with the largest base up to the value, else its first base; 0 if there is none.

    `table` is (thick, base, a, m) of a dictionary, so it is small; the offset from the base is not below 0.
    """
    rows = table.groupBy("thick").agg(F.array_sort(F.collect_list(F.struct("base", "a", "m"))).alias("rows"))
    got = df.join(F.broadcast(rows), F.col(key) == F.col("thick"), "left")
    up_to = F.filter("rows", lambda r: r["base"] <= F.col(value))
    row = F.when(F.size(up_to) > 0, F.element_at(up_to, -1)).otherwise(F.element_at("rows", 1))
    return got.withColumn("limit", F.coalesce(row["a"] * F.greatest(F.lit(0.0), F.col(value) - row["base"]) + row["m"], F.lit(0.0))).drop("rows", "thick")


def gaps(xs: Column) -> Column:
    """Distances of neighbours in an ascending array."""
    return F.when(F.size(xs) > 1, F.zip_with(F.slice(xs, F.lit(2), F.size(xs) - 1), F.slice(xs, F.lit(1), F.size(xs) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def drawing_grid(n_rows: Column, n_cols: Column, xs: Column, ys: Column) -> Column:
    """Whether a block's rulings are those of a drawing: too many columns, a flat strip, ticks, or uneven narrow columns."""
    across, down = gaps(xs), F.array_sort(gaps(ys))
    mean = _mean(across)
    spread = F.sqrt(_mean(F.transform(across, lambda g: (g - mean) * (g - mean)))) / mean
    uneven = F.when(F.size(xs) >= 3, F.when(mean > 0, spread).otherwise(0.0)).otherwise(0.0) >= 0.8
    narrow = F.size(F.filter(across, lambda g: g < 6.0)) / F.size(across) >= 0.5
    ticks = (n_rows >= 20) & (n_cols >= 8) & (F.size(ys) >= 3) & (F.try_element_at(down, (F.floor(F.size(down) / 2) + 1).cast("int")) < 8.0)
    return (n_cols >= 20) | ((n_rows <= 6) & (n_cols >= 15)) | F.coalesce(ticks, F.lit(False)) | F.coalesce((n_cols >= 15) & uneven & narrow, F.lit(False))


def stamp_block(width: Column, height: Column) -> Column:
    """A narrow column at the side or a wide strip."""
    return (width > 0) & (height > 0) & ((height > 3.0 * width) | (width > 8.0 * height))


def implied_bound(ends: Column, n_lines: Column, tolerance: float, share: float = 0.25) -> Column:
    """The centre of ends that most ends are near, if a quarter of the lines and two at least are; of equal ones the first.

    `ends` is an array of one block's ends outside it. Ends within the tolerance of the one before are one cluster.
    """
    ordered = F.array_sort(ends)
    start = F.struct(F.array().cast("array<array<double>>").alias("done"), F.array().cast("array<double>").alias("now"))
    add = lambda a, x: F.when((F.size(a["now"]) == 0) | (x - F.element_at(a["now"], -1) <= tolerance), F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(x)).alias("now"))).otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.array(x).alias("now")))
    clusters = F.aggregate(ordered, start, add, lambda a: F.concat(a["done"], F.array(a["now"])))
    centres = F.transform(F.filter(clusters, lambda c: F.size(c) > 0), _mean)
    ranked = F.transform(centres, lambda c: F.struct((-F.size(F.filter(ordered, lambda x: F.abs(x - c) <= tolerance))).alias("n"), c.alias("c")))
    best = F.array_min(ranked)
    return F.when(-best["n"] >= F.greatest(F.lit(2), F.floor(n_lines * share)), best["c"])
