"""Predicates and codes of recognised rows: totals, service rows, shapes, coats, sides, kinds of tables and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: words of totals and service rows, labels of coats, sides, roles
TOTALS = ("всего", "итого")
METAL_TOTALS = ("масса металла", "масса стали")
BREAKDOWN = "в том числе"
BARE_GRADE = r"^[CcСс][0-9]{3}"
SERVICE = r"(?iu)^$|^[СC€(\[]?\s?\d{3,4}[-–]?\d?$|^\d+$|%|наплав|неучт|неучёт|допуск на"
LEGACY = "__legacy"
BENT = ("channel_bent", "channel_unequal")
COATS = (("техно озм", "1"), ("taikor fp epoxy", "2"), ("taikor fp graphite", "3"), ("taikor fp extra + taikor fp graphite", "4"), ("акз", "1.5"))
SIDE_WORDS = (("left", "лев|left"), ("top", "верх|top|сверху"), ("right", "прав|right"), ("bottom", "низ|bottom|снизу"))
ATTENTION = ("Требует проверки", "Нужен ввод массы", "Нет данных")
MAIN_NEEDS, MAIN_NEEDS_ONE_OF = ("element_mass", "total_mass"), ("position", "profile_size", "profile_group", "steel_grade")


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_total(name: Column, profile: Column) -> Column:
    """Subtotals, grand totals, and breakdowns by grade, which repeat the mass of rows above."""
    n, p = _plain(name), _plain(profile)
    return _any([x.startswith(w) for x in (n, p) for w in TOTALS] + [F.contains(n, F.lit(w)) for w in (*METAL_TOTALS, BREAKDOWN)]) | F.trim(F.coalesce(profile, F.lit(""))).rlike(BARE_GRADE)


def is_service(group: Column) -> Column:
    """Blank names, bare grades and numbers, shares and allowances."""
    return F.trim(F.regexp_replace(F.coalesce(group, F.lit("")), r"\s+", " ")).rlike(SERVICE)


def shape_fits(row: Column, wanted: Column) -> Column:
    """Bent channels fit themselves and the plain channel only; other shapes fit by their start, either way; none fits all but bent ones."""
    start = lambda x: F.regexp_replace(x, "_$", "")
    r = F.coalesce(row, F.lit(""))
    return F.when(wanted.isin(*BENT), r == wanted).when(r.isin(*BENT), wanted == "channel_").otherwise((r == "") | F.startswith(r, start(wanted)) | F.startswith(wanted, start(r)))


def of_standard(standard: Column, wanted: Column) -> Column:
    """A missing standard is a standard of its own."""
    return F.coalesce(F.nullif(standard, F.lit("")), F.lit(LEGACY)) == wanted


def coat_code(label: Column) -> Column:
    """By the whole label, else the first that holds it or is held by it, else the first of all."""
    k = _plain(label)
    out = F.lit(COATS[0][1])
    for name, code in reversed(COATS):
        out = F.when(F.contains(k, F.lit(name)) | F.contains(F.lit(name), k), code).otherwise(out)
    for name, code in COATS:
        out = F.when(k == name, code).otherwise(out)
    return F.when(k == "", COATS[0][1]).otherwise(out)


def heated_sides(text: Column) -> Column:
    """left, top, right, bottom as they are named in a free text; none named means all."""
    t = _plain(text)
    flags = {side: t.rlike(words) for side, words in SIDE_WORDS}
    none = ~_any(list(flags.values()))
    return F.struct(*((none | flag).alias(side) for side, flag in flags.items()))


def lining(shape: Column, method: Column) -> Column:
    """3 along a pipe, 2 along the outline, 1 as a box."""
    return F.when(shape.startswith("tube_sm") & (method == "0"), 3).when(shape.startswith("brands") | shape.startswith("corner"), 2).otherwise(1)


def page_kind(images: Column, large_image: Column, lines: Column, glyphs: Column) -> Column:
    drawn = (lines > 0) | (glyphs > 0)
    return F.when(large_image & drawn, "mixed").when(large_image, "raster").when(drawn, "vector").when(images > 0, "raster").otherwise("empty")


def table_kind(df: DataFrame, table: str, role: str) -> DataFrame:
    """spec_main where masses by element and in total are there, and a column that tells what a row is; else generic."""
    has = lambda name: F.max((F.col(role) == name).cast("int")) == 1
    main = has(MAIN_NEEDS[0]) & has(MAIN_NEEDS[1]) & _any([has(x) for x in MAIN_NEEDS_ONE_OF])
    return df.groupBy(table).agg(F.when(main, "spec_main").otherwise("generic").alias("kind"))


def full_dims(shape: Column, dims: Column) -> Column:
    """Dimensions under the names that formulas use, where the catalog has others; what is there stays, but a round
    tube's h is its diameter and its wall becomes s. A zero does not fill."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    one = lambda name, value: F.when(F.coalesce(value, F.lit(0.0)) != 0, F.create_map(F.lit(name), value)).otherwise(none)

    def filled(*pairs: tuple[str, Column]) -> Column:
        out = dims
        for name, value in pairs:
            out = F.when(F.map_contains_key(out, name), out).otherwise(F.map_concat(out, one(name, value)))
        return out

    square = filled(("h", dims["A"]), ("b", F.coalesce(F.nullif(dims["A"], F.lit(0.0)), dims["B"])))
    pipe = F.when(F.map_contains_key(dims, "d"), F.map_concat(F.map_filter(filled(("s", dims["h"])), lambda k, _: k != "h"), F.create_map(F.lit("h"), dims["d"]))).otherwise(dims)
    angle = filled(("h", F.coalesce(dims["B"], dims["b"])), ("s", dims["t"]))
    return (
        F.when(shape.startswith("tube_sq"), square)
        .when(shape.isin("tube_sm", "tube_"), pipe)
        .when(shape.startswith("corner"), angle)
        .when(shape.startswith("profile"), filled(("s", dims["t"])))
        .when(shape.startswith("brands"), filled(("t", dims["S1"]), ("tr", dims["S2"])))
        .otherwise(dims)
    )


def source_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], source: str, only: str) -> DataFrame:
    """New rows of one source replace old ones of equal key, whatever their source, and unknown keys are added."""
    fresh = new.where(F.col(source) == only)
    return old.join(fresh.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
