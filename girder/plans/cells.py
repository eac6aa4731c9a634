"""Queries over broken numbers and marked rows, of texts put together from parts of the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from girder.functions.marks import DIGITS_IN_NUMBERS, LIKE_DIGITS_IN_NUMBERS
from girder.operators import cells

from .base import picked, query

_BEFORE = ("", "|", " ", "１", "+", "-", "З", "x", "1 ", '" ', "2\u00a0")
_BEHIND = ("", ",5", " 25", " 7", "\n3", ",4 1", ", 75", ".", ",,5", ".,7", " 250", "\u00a099", "О", ",B2", "|", "，5 ", " \n 12", None)
_READ = f"{picked('l_partkey', _BEFORE)} || l_suppkey || {picked('l_partkey * 3 + l_linenumber * 5', _BEHIND)} AS raw"
_OTHER = f"{picked('l_partkey + l_linenumber', ('1', '2', '', ' 1', None))} || l_suppkey || {picked('l_linenumber', ('', ',5', '.'))} AS other"
_W = "[ \t\n\u00a0\u2009]"
_LETTERS = f"[0-9%{LIKE_DIGITS_IN_NUMBERS}]+"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_READ}, {_OTHER} FROM lineitem),
a AS (SELECT *, array_to_string(list_transform(string_split(translate(raw, '０１２３４５６７８９，．－＋', '0123456789,.-+'), chr(10)),
  lambda x: regexp_replace(regexp_replace(x, '^{_W}*[|"`'']*{_W}*', ''), '{_W}*[|"`'']*{_W}*$', '')), chr(10)) AS lines FROM r),
p AS (SELECT *, CASE WHEN raw IS NOT NULL THEN regexp_replace(lines, '^{_W}+|{_W}+$', '', 'g') END AS plain FROM a),
b AS (SELECT *, CASE WHEN regexp_matches(plain, '^[-+]?{_LETTERS}([.,]{_LETTERS})?$') THEN translate(plain, '{LIKE_DIGITS_IN_NUMBERS}', '{DIGITS_IN_NUMBERS}') ELSE plain END AS b FROM p),
c AS (SELECT *, regexp_replace(b, '^([-+]?[0-9][0-9]+){_W}+([0-9][0-9]?)$', '\\1,\\2') AS c FROM b),
d AS (SELECT *, regexp_replace(c, '^([-+]?[0-9]+([.,][0-9]+)?)[ \t\u00a0\u2009]*\n{_W}*[0-9][0-9]?[0-9]?$', '\\1') AS d FROM c),
e AS (SELECT *, regexp_replace(d, '^([-+]?[0-9]+[.,][0-9]*)[ \t\u00a0\u2009]+([0-9][0-9]?[0-9]?)$', '\\1\\2') AS e FROM d),
f AS (SELECT *, regexp_replace(e, '^([-+]?[0-9]+)[.,]$', '\\1') AS f FROM e),
g AS (SELECT *, regexp_replace(f, '{_W}', '', 'g') AS bare FROM f),
h AS (SELECT *, CASE WHEN regexp_matches(f, '^[0-9]{_W}+[0-9][0-9]+([.,][0-9]+)?$') AND bare = regexp_replace(other, '{_W}', '', 'g') THEN bare ELSE f END AS h FROM g),
i AS (SELECT *, regexp_replace(h, '^([-+]?[0-9]+)[.,][.,]([0-9]+)$', '\\1,\\2') AS number FROM h),
n AS (SELECT *, CASE WHEN regexp_matches(number, '^[-+]?[0-9]+([.,][0-9]+)?$') OR regexp_matches(number, '^[-+]?[0-9][0-9]?[0-9]?({_W}[0-9][0-9][0-9])+([.,][0-9]+)?$')
  THEN CAST(replace(regexp_replace(number, '{_W}', '', 'g'), ',', '.') AS DOUBLE) END AS n FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, number, n AS mass, n IS NULL OR (number <> plain AND NOT regexp_matches(plain, '^[-+]?[0-9]+[.,]$')) AS review FROM n""")
def q_number_cells(t):
    """Numbers that a reader broke are mended; what was mended and what is no number is to be looked at."""
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _READ, _OTHER)
    rows = rows.withColumn("m", cells.mended_number(F.col("raw"), F.col("other")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("m.text").alias("number"), F.col("m.value").alias("mass"), F.col("m.review").alias("review"))


_LEADS = ("", "|", "  ", '"- ', "5 ", "не ", "\u00a0")
_WORDS = ("Итого", "ИTОГО  MACCA металла", "итог:", "Всего  металла", "Bсего профиля", "всего\u00a0масса металла", "Maсса\tметалла", "B том числе пo маркaм", "в том числе по наименованиям", "в том числе", "mо20", "Vmс20", "Балка", None)
_ENDINGS = ("", ":", " 12", " по листу")
_CELL = f"{picked('p_partkey', _LEADS)} || {picked('p_partkey * 3 + p_size', _WORDS)} || {picked('p_size', _ENDINGS)} AS raw"
_FOLDED = f"lower(translate(raw, '{cells.LIKE_CYRILLIC}', '{cells.CYRILLIC}'))"


@query(f"""
WITH r AS (SELECT p_partkey, {_CELL} FROM part),
k AS (SELECT p_partkey, raw, regexp_replace(regexp_replace({_FOLDED}, '^[^0-9a-zа-яё]+', ''), '{_W}+', ' ', 'g') AS k FROM r)
SELECT p_partkey, CASE WHEN regexp_matches(k, '^(итого масса металла|всего металла|всего масса металла|масса металла)') THEN 'grand_total' WHEN starts_with(k, 'итог') THEN 'group_total'
  WHEN starts_with(k, 'всего профиля') THEN 'profile_total' WHEN regexp_matches(k, '^в том числе по (марк|наимен)') THEN 'section_header'
  WHEN regexp_matches(regexp_replace(lower(raw), '{_W}', '', 'g'), '^[a-zа-я|]?[mт][оос0][2zг][0оo][:.,;]*$') THEN 'group_total' END AS marker FROM k""")
def q_row_markers(t):
    """Rows that their text makes totals or headings."""
    return t.part.selectExpr("p_partkey", _CELL).select("p_partkey", cells.row_marker(F.col("raw")).alias("marker"))
