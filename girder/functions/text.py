"""Text functions: profile marks, numbers, standards, markup, keys, page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words and patterns of profile marks
DROP_WORDS = ("ДВУТАВР", "БАЛКА", "ШВЕЛЛЕР", "УГОЛОК", "ТРУБА", "ЛИСТ", "КОЛОННА", "ПРОФИЛЬ", "ПРОКАТ", "СТАЛЬ", "КВАДРАТ", "КРУГ", "ПОЛОСА", "ГНУТОСВАРНОЙ")
STANDARD_PREFIXES = ("ГОСТ", "ОСТ", "ТУ", "СТО", "DIN", "EN", "ЕН")
GRADE = r"^(С\d{3}|СТ\d\S*|\d{2}Г\dС)$"
SERIES = r"^([0-9]+(?:[.,][0-9]+)?)([A-ZА-ЯЁ]+)([0-9]*)$"
SERIES_LATIN, SERIES_CYRILLIC = "BKMDHWPYU", "БКМДШШПУУ"


def normal_mark(raw: Column) -> Column:
    """Upper case, one size sign, without standards, grades and nouns; Latin series letters become Cyrillic."""
    words = F.split(F.upper(F.translate(F.trim(raw), "×*xX", "хххх")), r"\s+")
    standard = lambda w: F.exists(F.array(*map(F.lit, STANDARD_PREFIXES)), lambda p: w.startswith(p))
    first = F.array_position(F.transform(words, standard), F.lit(True)).cast("int")
    head = F.when(first > 0, F.slice(words, F.lit(1), first - 1)).otherwise(words)
    mark = F.array_join(F.filter(head, lambda w: ~w.isin(*DROP_WORDS) & ~w.rlike(GRADE)), "")
    part = lambda k: F.regexp_extract(mark, SERIES, k)
    return F.when(mark.rlike(SERIES), F.concat(part(1), F.translate(part(2), SERIES_LATIN, SERIES_CYRILLIC), part(3))).otherwise(mark)


def three_number_angle(mark: Column) -> Column:
    return F.regexp_replace(mark, r"^([0-9]+)Х([0-9]+(?:[.,][0-9]+)?)$", "$1Х$1Х$2")


def number(text: Column) -> Column:
    """A number with a decimal comma or point and blanks between thousands, else null. Any white space of Unicode is a blank."""
    bare = F.trim(F.regexp_replace(text, r"(?U)\s", " "))
    good = bare.rlike(r"^[+-]?([0-9]+|[0-9]{1,3}( [0-9]{3})+)([.,][0-9]+)?$")
    return F.when(good, F.replace(F.replace(bare, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def standards(text: Column) -> Column:
    """Standards in a text, in one spelling, first of each."""
    found = F.regexp_extract_all(text, F.lit(r"(ГОСТ( Р)?|СТО|ТУ) *[0-9][0-9.]*(-[0-9]{2,4})?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, " +", " "), r"^(ГОСТ Р|ГОСТ|СТО|ТУ) ?", "$1 ")))


def standard_number(standard: Column) -> Column:
    """Without the year."""
    return F.regexp_extract(standard, r"([0-9][0-9.]*)-[0-9]{2,4}", 1)


def without_markup(html: Column) -> Column:
    bare = F.regexp_replace(html, "<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return bare


def group_key(name: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(F.trim(name), r"\s+", " "), F.lit(" / "), F.lit("/")))


def capitalised(text: Column) -> Column:
    """The first letter only; the rest is left as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.expr("''") if text is None else text.substr(F.lit(2), F.length(text)))


def pages(spec: Column) -> Column:
    """`1-3,5` as sorted distinct numbers."""
    part = lambda p, k: F.regexp_extract(F.trim(p), r"^([0-9]+)(?:-([0-9]+))?$", k).try_cast("int")
    each = F.transform(F.split(spec, ","), lambda p: F.when(part(p, 1).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(part(p, 1), F.greatest(part(p, 1), F.coalesce(part(p, 2), part(p, 1))))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def map_signature(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
