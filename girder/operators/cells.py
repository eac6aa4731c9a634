"""Cells as a reader of drawings leaves them: broken numbers, and texts that mark a row as a total or a heading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from girder.functions import marks, text

# ---- fixed values: signs of rulings, full-width signs, how numbers break (in this order), texts of marked rows
RULINGS = "|\"'`"
FULL_WIDTH, NARROW = "０１２３４５６７８９，．－＋", "0123456789,.-+"
BREAKS = (
    (r"(?U)^([+-]?[0-9]{2,})\s+([0-9]{1,2})$", "$1,$2"),  # a blank for the comma
    (r"(?U)^([+-]?[0-9]+(?:[.,][0-9]+)?)[^\S\n]*\n\s*[0-9]{1,3}$", "$1"),  # a scrap on a second line
    (r"(?U)^([+-]?[0-9]+[.,][0-9]*)[^\S\n]+([0-9]{1,3})$", "$1$2"),  # a blank in the fraction
)
BARE_SEPARATOR = r"^([+-]?[0-9]+)[.,]$"
SPLIT_WHOLE = r"(?U)^[0-9]\s+[0-9]{2,}(?:[.,][0-9]+)?$"
TWO_SEPARATORS = r"^([+-]?[0-9]+)[.,][.,]([0-9]+)$"
MARKERS = (
    ("итого масса металла", "grand_total"),
    ("итого", "group_total"),
    ("итог", "group_total"),
    ("всего металла", "grand_total"),
    ("всего профиля", "profile_total"),
    ("всего масса металла", "grand_total"),
    ("масса металла", "grand_total"),
    ("в том числе по маркам или наименованиям", "section_header"),
    ("в том числе по марк", "section_header"),
    ("в том числе по наимен", "section_header"),
)
LIKE_CYRILLIC, CYRILLIC = "ABCEHKMOPTXYWaceopxy", "АВСЕНКМОРТХУШасеорху"
BEFORE_WORDS = r"^[^0-9A-Za-zА-Яа-яЁё]+"
SLANTED_TOTAL = r"^[a-zа-я|]?[mт][оос0][2zг][0оo][:.,;]*$"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _compact(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def without_rulings(raw: Column) -> Column:
    """Each line without the signs that a table's rulings leave at its ends."""
    line = lambda x: _stripped(F.regexp_replace(_stripped(x), f"^[{RULINGS}]+|[{RULINGS}]+$", ""))
    return F.array_join(F.transform(F.split(raw, "\n"), line), "\n")


def mended_number(raw: Column, other: Column) -> Column:
    """A struct of a numeric cell's text, its value, and whether someone should look at it.

    A blank within a whole number goes only if the other reader has the same digits without it. Mended numbers are to be
    looked at, and texts that are no number after all; a separator without a fraction is printed so, and just goes.
    """
    plain = _stripped(without_rulings(F.translate(raw, FULL_WIDTH, NARROW)))
    mended = reduce(lambda x, rule: F.regexp_replace(x, *rule), BREAKS, _stripped(marks.digits_in_numbers(plain)))
    whole = F.regexp_replace(mended, BARE_SEPARATOR, "$1")
    agreed = F.coalesce(_compact(whole) == _compact(other), F.lit(False))
    last = F.regexp_replace(F.when(whole.rlike(SPLIT_WHOLE) & agreed, _compact(whole)).otherwise(whole), TWO_SEPARATORS, "$1,$2")
    value = text.number(last)
    changed = (last != plain) & ~plain.rlike(BARE_SEPARATOR)
    return F.struct(last.alias("text"), value.alias("value"), (value.isNull() | F.coalesce(changed, F.lit(True))).alias("review"))


def row_marker(raw: Column) -> Column:
    """What a row is by the start of its text, Latin letters read as the Cyrillic ones they look like; else null.

    Texts that only resemble a marker are not told here.
    """
    key = F.lower(F.translate(raw, LIKE_CYRILLIC, CYRILLIC))
    key = _stripped(F.regexp_replace(F.regexp_replace(key, BEFORE_WORDS, ""), r"(?U)\s+", " "))
    slanted = F.when(_compact(F.lower(raw)).rlike(SLANTED_TOTAL), "group_total")
    return reduce(lambda rest, marker: F.when(key.startswith(marker[0]), marker[1]).otherwise(rest), reversed(MARKERS), slanted)
