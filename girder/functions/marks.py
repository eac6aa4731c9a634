"""Marks of profiles as they are printed, and the spellings under which catalogs hold them; letters read for digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what is printed around a mark, in the order in which it is taken away
AROUND_A_MARK = (
    r"[\uE000-\uF8FF]",  # private signs of drawing fonts
    r"^\s+|\s+$",
    r"(?iu)^гн\.?\s*",
    r"(?iu)^тр\.?\s*(?=\d)",
    r"^[1lI|]\s+(?=[\d□∟⌶])",
    r"^[□∟⌶ΙI|L\[\]]\s*(?=\d)",
    r"^[□∟⌶]\s*",
    r"(?iu)\s*(?:мм|mm)$",
    r"^\s*\(\s*\d[\d\s.\-/]*\)\s*",
    r"\s*\(\s*\d[\d\s.\-/]*\)\s*$",
)
DESIGNATION = r"\d{2,3}[БШКДМBWKDM]\d?|\d{1,3}(?:[.,]\d)?[хx×]\d{1,3}(?:[хx×]\d{1,2}(?:[.,]\d)?)?|\d{1,3}[ПпPp]а?|[tT]\s?\d{1,3}(?:[хx×]\d{1,3})?|RD\d{1,3}"
SIGN_BEHIND = r"[тТLlСC71IΙ□◻■⌶∟⌐\[]"
BOOK_SERIES = r"^([0-9]+(?:\.[0-9]+)?)([A-ZА-Я]+)([0-9]*)$"
BOOK_LATIN, BOOK_CYRILLIC = "BPYKMCEDW", "БПУКМСЕДШ"
LIKE_DIGITS, DIGITS = "ЗзОоOlI", "3300011"
LIKE_DIGITS_IN_NUMBERS, DIGITS_IN_NUMBERS = "ЗзОоOlIВвBЧчбБТT|SsgqDd", "33000118884466771559900"
TONNES = ("t", "т", "тн", "тонн", "тонна", "тонны")
BEFORE_STANDARD = r"(?iu)^(.+?)(?:\s+по)?\s(?:ГОСТ|СТО|ТУ|EN|DIN)(?=\s|$).*$"


def cleaned_mark(raw: Column) -> Column:
    """A mark without signs, prefixes, units and codes of parts; null is empty.

    A single sign behind it goes only if what stands before it is a designation.
    """
    bare = reduce(lambda s, pattern: F.regexp_replace(s, pattern, ""), AROUND_A_MARK, F.coalesce(raw, F.lit("")))
    one_line = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.regexp_replace(one_line, rf"^({DESIGNATION})\s+{SIGN_BEHIND}$", "$1")


def book_key(raw: Column) -> Column:
    """Key of the book of masses: upper case, one size sign, decimal points, Cyrillic series; О behind a series is 0."""
    plain = F.translate(F.regexp_replace(F.upper(cleaned_mark(raw)), r"\s+", ""), "X×*,", "ХХХ.")
    part = lambda k: F.regexp_extract(plain, BOOK_SERIES, k)
    series = F.translate(part(2), BOOK_LATIN, BOOK_CYRILLIC)
    zeros = series.rlike("^[БШКДМ][ОO]{1,2}$") & (part(3) == "")
    tail = F.when(zeros, F.concat(F.substring(series, 1, 1), F.translate(series.substr(F.lit(2), F.length(series)), "ОO", "00"))).otherwise(F.concat(series, part(3)))
    return F.when(plain.rlike(BOOK_SERIES), F.concat(part(1), tail)).otherwise(plain)


def spellings(kind: Column, mark: Column) -> Column:
    """The mark, and how catalogs write the same profile: `a/bхt` of unequal angles, `aхt` of equal ones and square tubes."""
    size = r"^([0-9]+(?:[.,][0-9]+)?)\s*[xх×*]\s*([0-9]+(?:[.,][0-9]+)?)(?:\s*[xх×*]\s*([0-9]+(?:[.,][0-9]+)?))?$"
    a, b, c = (F.regexp_extract(mark, size, k) for k in (1, 2, 3))
    three, two = mark.rlike(size) & (c != ""), mark.rlike(size) & (c == "")
    x, none = F.lit("х"), F.lit(None).cast("string")
    short = F.when(three & (a == b), F.concat(a, x, c)).when(three & (kind == "angle"), F.concat(a, F.lit("/"), b, x, c)).otherwise(none)
    long = F.when(two & (kind == "square tube"), F.concat(a, x, a, x, b)).otherwise(none)
    return F.array_compact(F.array(mark, F.when(kind.isin("angle", "square tube"), short), long))


def digits_in_context(raw: Column) -> Column:
    """Letters that look like digits, where they touch one.

    A run of such letters behind a digit is digits as a whole, since each is followed from the one before; of a run
    that only stands before a digit just the last letter is.
    """
    runs = F.regexp_extract_all(raw, F.lit(f"[{LIKE_DIGITS}]+|[^{LIKE_DIGITS}]+"), F.lit(0))

    def read(run: Column, at: Column) -> Column:
        before, behind = F.get(runs, at - 1), F.get(runs, at + 1)
        last = F.concat(run.substr(F.lit(1), F.length(run) - 1), F.translate(F.right(run, F.lit(1)), LIKE_DIGITS, DIGITS))
        letters = run.rlike(f"^[{LIKE_DIGITS}]")
        return F.when(letters & F.coalesce(before.rlike("[0-9]$"), F.lit(False)), F.translate(run, LIKE_DIGITS, DIGITS)).when(letters & F.coalesce(behind.rlike("^[0-9]"), F.lit(False)), last).otherwise(run)

    return F.array_join(F.transform(runs, read), "")


def digits_in_numbers(raw: Column) -> Column:
    """In a column of numbers: all such letters, if the text then is a number; other texts stay."""
    may = f"[0-9%{LIKE_DIGITS_IN_NUMBERS}]+"
    return F.when(F.trim(raw).rlike(rf"^[+-]?{may}(?:[.,]{may})?$"), F.translate(F.trim(raw), LIKE_DIGITS_IN_NUMBERS, DIGITS_IN_NUMBERS)).otherwise(raw)


def short_group(name: Column, default: str) -> Column:
    """What stands before the standard; a blank name is the default."""
    line = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(line, BEFORE_STANDARD, "$1")), F.lit("")), F.lit(default))


def path_segment(text: Column) -> Column:
    """Escaped for the path of a URL: blanks are %20 there, not plus signs."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def shown(x: Column, digits: int) -> Column:
    """Thousands parted by no-break spaces, a decimal comma, a dash for null."""
    return F.coalesce(F.translate(F.format_number(x, digits), ",.", " ,"), F.lit("—"))


def lines_of(trace: Column, owner: Column) -> Column:
    """Of an array of `owner: line` the lines of one owner."""
    prefix = F.concat(owner, F.lit(": "))
    return F.transform(F.filter(trace, lambda x: x.startswith(prefix)), lambda x: x.substr(F.length(prefix) + 1, F.length(x)))


def with_defaults(own: Column, defaults: Column) -> Column:
    """A map with the keys of another that it has not; a value of null or 0 counts as there."""
    return F.map_concat(own, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)))


def kilograms(x: Column, unit: Column) -> Column:
    return F.when(F.lower(F.trim(unit)).isin(*TONNES), x * 1000).otherwise(x)
