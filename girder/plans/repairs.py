"""Queries over printed marks, misread digits, two readings of a cell, grids of tables, units and display."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.functions import marks
from girder.functions.rounding import divided, scaled
from girder.operators import grids, readings

from .base import query


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'х' || p_size || 'х5' WHEN 1 THEN p_size || 'х4' WHEN 2 THEN (p_size + 10) || 'B1' WHEN 3 THEN p_size || 'x3,5' ELSE (p_size + 10) || 'ШО' END AS mark,
  CASE p_partkey % 5 WHEN 0 THEN p_size || 'Х' || p_size || 'Х5' WHEN 1 THEN p_size || 'Х4' WHEN 2 THEN (p_size + 10) || 'Б1' WHEN 3 THEN p_size || 'Х3.5' ELSE (p_size + 10) || 'Ш0' END AS key FROM part""")
def q_mark_clean(t):
    """Signs, prefixes, units and codes around a mark go; the answer is known from how the marks were made."""
    size, k = F.col("p_size"), F.col("p_partkey") % 5
    raw = F.when(k == 0, _text("1 □", size, "х", size, "х5 мм")).when(k == 1, _text("Гн. ", size, "х4 (214-202-0103)")).when(k == 2, _text("I ", size + 10, "B1 т")).when(k == 3, _text("Тр.", size, "x3,5")).otherwise(_text(size + 10, "ШО"))
    return t.part.select("p_partkey", marks.cleaned_mark(raw).alias("mark"), marks.book_key(raw).alias("key"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'х' || p_size || 'х5|' || p_size || 'х5' WHEN 1 THEN (p_size + 1) || 'х' || p_size || 'х5|' || (p_size + 1) || '/' || p_size || 'х5'
  WHEN 2 THEN p_size || 'х7|' || p_size || 'х' || p_size || 'х7' ELSE p_size || 'Б1' END AS spellings FROM part""")
def q_mark_spellings(t):
    size, k = F.col("p_size"), F.col("p_partkey") % 4
    raw = F.when(k == 0, _text(size, "х", size, "х5")).when(k == 1, _text(size + 1, "х", size, "х5")).when(k == 2, _text(size, "х7")).otherwise(_text(size, "Б1"))
    kind = F.when(k < 2, "angle").when(k == 2, "square tube").otherwise("beam")
    return t.part.select("p_partkey", F.array_join(marks.spellings(kind, raw), "|").alias("spellings"))


@query("""
SELECT p_partkey, 'С' || p_size || '3' || CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '' END || '-5 ГОСТ З01' AS near, CASE WHEN p_partkey % 3 = 0 THEN 'Вес ' || p_size ELSE p_size || ',82' END AS number FROM part""")
def q_digit_repair(t):
    """Letters read for digits, beside digits and in columns of numbers; words stay."""
    size = F.col("p_size")
    near = _text("С", size, "З", F.when(F.col("p_partkey") % 2 == 0, "О").otherwise(""), "-5 ГОСТ ЗО1")
    number = F.when(F.col("p_partkey") % 3 == 0, _text("Вес ", size)).otherwise(_text(size, ",В2"))
    return t.part.select("p_partkey", marks.digits_in_context(near).alias("near"), marks.digits_in_numbers(number).alias("number"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Профиль ' || p_type WHEN 1 THEN p_name ELSE 'Элемент' END AS name, 'spravka/' || replace(p_name, ' ', '%20') AS path,
  CASE WHEN p_size > 45 THEN '—' ELSE translate(format('{:,.2f}', p_retailprice * 4), ',.', chr(160) || ',') END AS shown FROM part""")
def q_display(t):
    """Names without standards, paths of URLs, numbers as they are shown."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, _text(" Профиль  ", F.col("p_type"), " по ГОСТ 30245-2012")).when(k == 1, F.col("p_name")).otherwise("  ")
    return t.part.select("p_partkey", marks.short_group(raw, "Элемент").alias("name"), _text("spravka/", marks.path_segment(F.col("p_name"))).alias("path"), marks.shown(F.when(F.col("p_size") <= 45, F.col("p_retailprice") * 4), 2).alias("shown"))


@query("""
SELECT p_partkey, p_name || chr(10) || p_type AS lines FROM part""")
def q_trace_lines(t):
    """The lines of one owner out of a trace that has those of all."""
    owner = F.col("p_partkey").cast("string")
    trace = F.array(_text(owner, ": ", F.col("p_name")), _text("1", owner, ": other"), F.lit("no owner"), _text(owner, ": ", F.col("p_type")))
    return t.part.select("p_partkey", F.array_join(marks.lines_of(trace, owner), "\n").alias("lines"))


@query("""
SELECT p_partkey, concat_ws('|', 'b=' || p_size, CASE WHEN p_partkey % 2 = 0 THEN 'h=0' ELSE 'h=7' END, 's=3') AS dims FROM part""")
def q_map_defaults(t):
    """Missing dimensions come from the catalog; a zero is not missing."""
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("b"), F.col("p_size"), F.lit("h"), F.lit(0))).otherwise(F.create_map(F.lit("b"), F.col("p_size")))
    full = marks.with_defaults(own, F.create_map(F.lit("h"), F.lit(7), F.lit("b"), F.lit(9), F.lit("s"), F.lit(3)))
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(full)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("dims"))


@query("""
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS kg, CAST(p_size % 7 AS DOUBLE) AS per, p_size FROM part)
SELECT p_partkey, kg, CASE WHEN per > 0 THEN round(kg / per * 100.0) / 100.0 ELSE 0.0 END AS length, round(kg / 1000.0 * 1000000.0) / 1000000.0 AS tonnes, greatest(p_size, 20) AS rate FROM m""")
def q_linear_metres(t):
    """Length from mass, whatever the unit; 0 without a mass a metre. Tonnes to six places; a rate not below its floor."""
    unit = F.when(F.col("p_partkey") % 2 == 0, " Тонн").otherwise("кг")
    kg = marks.kilograms(F.col("p_retailprice"), unit)
    per = (F.col("p_size") % 7).cast("double")
    return t.part.select("p_partkey", kg.alias("kg"), scaled(divided(kg, per), 2).alias("length"), scaled(kg / 1000.0, 6).alias("tonnes"), F.greatest(F.col("p_size"), F.lit(20)).alias("rate"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'words' WHEN 1 THEN 'signs' WHEN 2 THEN 'words' WHEN 3 THEN 'words' ELSE 'signs' END AS reader,
  CASE WHEN p_partkey % 2 = 0 THEN 'Сталь С' || (200 + p_size) || '-4, лист' ELSE 'Сталь С215-3, лист' END AS grade FROM part""")
def q_two_readings(t):
    """Which of two readers to trust, and a grade's digits from the one that reads digits better."""
    size, k = F.col("p_size"), F.col("p_partkey") % 5
    words = F.when(k == 0, "Колонна").when(k == 1, _text(size, "x")).when(k == 2, _text(size, ",3")).when(k == 3, _text(size, ",19")).otherwise(_text("L ", size))
    signs = F.when(k == 0, "KoAoHHa").when(k == 1, _text("L ", size, "x8")).when(k == 2, _text("E'", size, "E")).when(k == 3, _text(size, " 49")).otherwise(_text(size, "x5,5"))
    lender = F.when(F.col("p_partkey") % 2 == 0, _text("C", 200 + size, "-4")).otherwise("C245 C255")
    return t.part.select("p_partkey", readings.trusted(words, signs).alias("reader"), readings.lent_grade(F.lit("Сталь С215-3, лист"), lender).alias("grade"))


@query("""
WITH w AS (SELECT user_id AS page, event_id, event_id % 97 AS x0, event_id % 97 + 8 AS x1, CAST(floor(value) AS BIGINT) % 61 AS y0, CAST(floor(value) AS BIGINT) % 61 + 4 AS y1 FROM events),
c AS (SELECT o_custkey AS page, o_orderkey AS cell, o_orderkey % 80 AS x0, o_orderkey % 80 + 30 AS x1, o_orderkey * 7 % 50 AS y0, o_orderkey * 7 % 50 + 15 AS y1 FROM orders),
m AS (SELECT event_id, cell, greatest(0, least(w.x1, c.x1) - greatest(w.x0, c.x0)) * greatest(0, least(w.y1, c.y1) - greatest(w.y0, c.y0)) AS common FROM w JOIN c USING (page)),
b AS (SELECT event_id, cell, row_number() OVER (PARTITION BY event_id ORDER BY common DESC, cell) AS n FROM m WHERE common >= 16)
SELECT event_id, cell FROM events LEFT JOIN (SELECT event_id, cell FROM b WHERE n = 1) USING (event_id)""")
def q_words_in_cells(t):
    """Each word in the cell that covers most of it, at least half."""
    x, y = F.col("event_id") % 97, F.floor("value") % 61
    words = t.events.select(F.col("user_id").alias("page"), "event_id", x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 4).alias("y1"))
    x, y = F.col("o_orderkey") % 80, F.col("o_orderkey") * 7 % 50
    cells = t.orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("cell"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 15).alias("y1"))
    return grids.words_in_cells(words, cells, "page", "event_id", "cell", 0.5, 30)


@query("""
WITH RECURSIVE n AS (SELECT s_suppkey, r, c, s_suppkey * 12 + r * 4 + c AS node FROM supplier, range(3) a(r), range(4) b(c)),
e AS (SELECT node AS a, node + 1 AS b FROM n WHERE c < 3 AND (s_suppkey * 7 + r * 3 + c * 5) % 4 = 0 UNION ALL SELECT node, node + 4 FROM n WHERE r < 2 AND (s_suppkey * 5 + r * 11 + c * 3) % 5 = 0),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT node, node AS here FROM n UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.here),
k AS (SELECT node, min(here) AS comp FROM reach GROUP BY 1),
s AS (SELECT comp, count(*) AS n, min(r) AS r, min(c) AS c, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM n JOIN k USING (node) GROUP BY 1),
f AS (SELECT n.s_suppkey, n.r, n.c, s.r AS r0, s.c AS c0, s.h, s.w, s.n = s.h * s.w AS whole FROM n JOIN k USING (node) JOIN s USING (comp))
SELECT DISTINCT s_suppkey, CASE WHEN whole THEN r0 ELSE r END AS r, CASE WHEN whole THEN c0 ELSE c END AS c, CASE WHEN whole THEN h ELSE 1 END AS rows, CASE WHEN whole THEN w ELSE 1 END AS columns FROM f""")
def q_merged_cells(t):
    """Grids of three by four whose inner lines are there or not by a rule."""
    s, r, c = F.col("s_suppkey"), F.col("r"), F.col("c")
    nodes = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).withColumn("node", s * 12 + r * 4 + c)
    right = nodes.where((c < 3) & ((s * 7 + r * 3 + c * 5) % 4 == 0)).select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    down = nodes.where((r < 2) & ((s * 5 + r * 11 + c * 3) % 5 == 0)).select(F.col("node").alias("a"), (F.col("node") + 4).alias("b"))
    return grids.merged_cells(nodes, right.unionAll(down), ["s_suppkey"], "node")


_LINES = "SELECT user_id, 20.0::DOUBLE * (row_number() OVER w + sum((event_id % 13 = 0)::INT) OVER w) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(f"""
WITH l AS ({_LINES}), g AS (SELECT *, lead(y) OVER (PARTITION BY user_id ORDER BY y) - y AS gap FROM l),
p AS (SELECT user_id, arg_max(gap, n * 1000000 - gap) AS pitch, max(n) AS n FROM (SELECT user_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT g.user_id, y, gap, CASE WHEN p.n >= 4 AND round_even(gap / pitch, 0) >= 2 AND abs(gap - round_even(gap / pitch, 0) * pitch) <= 2 THEN CAST(round_even(gap / pitch, 0) AS BIGINT) ELSE 1 END AS k FROM g LEFT JOIN p ON p.user_id = g.user_id)
SELECT user_id, CASE WHEN j = 0 THEN y ELSE y + j * gap / k END AS y FROM (SELECT *, unnest(range(k)) AS j FROM k)""")
def q_even_pitch(t):
    """Lines put in where a gap is a multiple of the most frequent one."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    place = F.count(F.lit(1)).over(w) + F.sum((F.col("event_id") % 13 == 0).cast("int")).over(w)
    return grids.at_even_pitch(t.events.select("user_id", (20.0 * place).alias("y")), ["user_id"], "y")


@query("""
SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (WHERE l_partkey % 11 = 0), sum(l_quantity) FILTER (WHERE l_partkey % 4 = 0 AND l_partkey % 11 <> 0)) AS calculated,
  arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) FILTER (WHERE l_linenumber = 1) AS printed FROM lineitem GROUP BY 1""")
def q_grand_total(t):
    """Profile totals add up to the grand total, without them group totals; of several grand totals the last counts."""
    v, key = F.col("l_quantity"), F.col("l_partkey")
    profile, group = F.sum(F.when(key % 11 == 0, v)), F.sum(F.when((key % 4 == 0) & (key % 11 != 0), v))
    last = F.max(F.when(F.col("l_linenumber") == 1, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")))
    return t.lineitem.groupBy("l_suppkey").agg(F.coalesce(profile, group).alias("calculated"), last["l_quantity"].alias("printed"))


@query("""
SELECT user_id, event_id, (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_custkey = user_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events""")
def q_next_id(t):
    """New rows go on from the largest number of their owner; numbering is by owner, so no task sees all rows."""
    used = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("used"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id").join(used, "user_id", "left").select("user_id", "event_id", (F.coalesce("used", F.lit(0)) + n).alias("next_id"))


@query("""
SELECT p_partkey, '{"p_name":"' || p_name || '","p_size":' || p_size || '}' AS payload, TRUE AS fits FROM part""")
def q_json_encode(t):
    """Payloads as JSON, with the check of their size in bytes."""
    payload = F.to_json(F.struct("p_name", "p_size"))
    return t.part.select("p_partkey", payload.alias("payload"), (F.octet_length(payload) <= 256 * 1024).alias("fits"))
