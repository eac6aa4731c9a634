"""Two readings of one cell: which to trust, and what one lends the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: shapes of readings
NUMBER = r"^[+-]?[0-9]+(?:[.,][0-9]+)?$"
DECIMAL = r"^[+-]?[0-9]+[.,][0-9]+$"
LOST_COMMA = r"^[0-9]+ [0-9]{1,2}$"
GRADE = r"[CС]\s?([0-9]{3})(?:-([0-9]))?"


def trusted(words: Column, signs: Column) -> Column:
    """`words` or `signs`: the reader that is good at words, or the one that is good at numbers and sizes.

    The second reader's text tells what is there: three letters, or letters without a digit, are words. The first also wins
    where it alone has a number, the decimal comma, or more digits of a decimal. Null counts as blank.
    """
    w, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (words, signs))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    fewer = w.rlike(DECIMAL) & ~s.rlike(DECIMAL) & (digits(s) < digits(w))
    is_word = (s == "") | (letters >= 3) | ((letters > 0) & (digits(s) == 0))
    return F.when(is_word | (w.rlike(NUMBER) & ~s.rlike(NUMBER)) | (w.rlike(DECIMAL) & s.rlike(LOST_COMMA)) | fewer, "words").otherwise("signs")


def lent_grade(words: Column, signs: Column) -> Column:
    """The first grade of steel in `words` with the digits of the only one in `signs`; with none or several there, as it is."""
    found = F.regexp_extract_all(signs, F.lit(GRADE), F.lit(0))
    digits, index = (F.regexp_extract(signs, GRADE, k) for k in (1, 2))
    own, own_index = F.regexp_extract(words, GRADE, 0), F.regexp_extract(words, GRADE, 2)
    head = F.regexp_extract(own, r"^([CС]\s?)", 1)
    tail = F.when(own_index == "", "").otherwise(F.concat(F.lit("-"), F.coalesce(F.nullif(index, F.lit("")), own_index)))
    at = F.instr(words, own)
    mended = F.concat(words.substr(F.lit(1), at - 1), head, digits, tail, words.substr(at + F.length(own), F.length(words)))
    return F.when((F.size(found) == 1) & (own != ""), mended).otherwise(words)
