"""Queries over predicates and codes of recognised rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.operators import classify, gates

from .base import picked, query

_SHAPES = ("I-beam_", "channel_", "channel_bent", "corner_e", "corner_", "tube_sq", "tube_sm", "")


def _pick(index, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_HEADS = ("", "  ", "Балка ", "ВСЕГО ", "Итого", " итого ", "Общая масса стали ", "масса  металла", "Масса металла: ", "в том числе ", "Связи, В ТОМ ЧИСЛЕ ", "не всего ", None)
_TAILS = ("", "по маркам", "профиля", "20Б1", "С255", "итого")
_GRADES = ("С2", " C3", "c24", "Сталь С255", "L75x6", "всего ", "Итого ", "t10 в том числе ", "К2", "с34", None)
_ROW = (f"{picked('p_partkey', _HEADS)} || {picked('p_partkey * 7 + p_size * 3', _TAILS)} AS name", f"{picked('p_partkey * 5 + p_size', _GRADES)} || p_size AS profile")


@query(f"""
WITH r AS (SELECT p_partkey, {', '.join(_ROW)} FROM part), k AS (SELECT p_partkey, lower(trim(coalesce(name, ''))) AS n, lower(trim(coalesce(profile, ''))) AS p, trim(coalesce(profile, '')) AS raw FROM r)
SELECT p_partkey FROM k WHERE NOT regexp_matches(n, '^(всего|итого)') AND NOT regexp_matches(p, '^(всего|итого)') AND n NOT LIKE '%масса металла%' AND n NOT LIKE '%масса стали%'
  AND n NOT LIKE '%в том числе%' AND NOT regexp_matches(raw, '^[CcСс][0-9][0-9][0-9]')""")
def q_element_rows(t):
    """Rows that are neither totals nor breakdowns, of names and profiles put together from parts."""
    rows = t.part.selectExpr("p_partkey", *_ROW)
    return rows.where(~gates.is_total(F.col("name"), F.col("profile"))).select("p_partkey")


_OPENERS = ("", " ", "С", "C ", "(", "[ ", "€2", "С2", "Лист t", "Масса  Наплавленного металла ", "НЕУЧТЕННЫЕ ", "неучёт ", "Допуск  на ", "допуск ", None)
_CLOSERS = ("", "5", "-5", "–3", "55-4", "00", " %", "x8", ")", "  ")
_GROUP = f"{picked('p_partkey', _OPENERS)} || {picked('p_partkey * 3 + p_size', ('', '1', '24'))} || p_size || {picked('p_partkey * 7 + p_size * 5', _CLOSERS)}"
_MAYBE_BLANK = f"CASE WHEN p_partkey % 17 = 0 THEN {picked('p_size', ('', '   ', ' 7 ', '%'))} ELSE {_GROUP} END AS name"


@query(f"""
WITH r AS (SELECT p_partkey, {_MAYBE_BLANK} FROM part), k AS (SELECT p_partkey, trim(regexp_replace(coalesce(name, ''), '[ \t\n]+', ' ', 'g')) AS n FROM r)
SELECT p_partkey, n = '' OR regexp_matches(n, '^[0-9]+$') OR regexp_matches(n, '^[[(СCсc€]?[ ]?[0-9][0-9][0-9][0-9]?[-–]?[0-9]?$') OR contains(n, '%') OR contains(lower(n), 'наплав')
  OR contains(lower(n), 'неучт') OR contains(lower(n), 'неучёт') OR contains(lower(n), 'допуск на') AS service FROM k""")
def q_service_rows(t):
    """Blank names, bare grades and numbers, shares and allowances, among names put together from parts."""
    return t.part.selectExpr("p_partkey", _MAYBE_BLANK).select("p_partkey", gates.is_service(F.col("name")).alias("service"))


@query(f"""
WITH p AS (SELECT p_partkey, {_list(_SHAPES)}[p_partkey % 8 + 1] AS r FROM part), w AS (SELECT *, unnest({_list(_SHAPES[:6])}) AS w FROM p)
SELECT p_partkey, w AS wanted, CASE WHEN w = 'channel_bent' THEN r = w WHEN r = 'channel_bent' THEN w = 'channel_' ELSE r = '' OR starts_with(r, rtrim(w, '_')) OR starts_with(w, rtrim(r, '_')) END AS fits FROM w""")
def q_shape_fits(t):
    wanted = F.explode(F.array(*map(F.lit, _SHAPES[:6]))).alias("wanted")
    rows = t.part.select("p_partkey", _pick(F.col("p_partkey"), _SHAPES).alias("shape"), wanted)
    return rows.select("p_partkey", "wanted", gates.shape_fits(F.col("shape"), F.col("wanted")).alias("fits"))


@query("""
SELECT p_partkey FROM part WHERE p_size > 25""")
def q_legacy_standard(t):
    """Rows of the catalog that have no standard."""
    standard = F.when(F.col("p_size") <= 25, F.lit("ГОСТ 8240-97")).when(F.col("p_size") <= 40, F.lit("")).otherwise(F.lit(None).cast("string"))
    return t.part.where(gates.of_standard(standard, F.lit(gates.LEGACY))).select("p_partkey")


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'profile' ELSE 'sheet' END AS list FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, list ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) AS place FROM r)
SELECT l_suppkey, list, place, l_returnflag FROM n WHERE l_returnflag <> 'N'""")
def q_attention(t):
    """Rows are dealt to two lists and numbered there; of those that need attention the numbers are told."""
    status = F.when(F.col("l_returnflag") == "R", gates.ATTENTION[0]).when(F.col("l_returnflag") == "A", gates.ATTENTION[2]).otherwise("Рассчитано")
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.when(F.col("l_linestatus") == "O", "profile").otherwise("sheet").alias("list"), status.alias("status"))
    place = F.row_number().over(W.partitionBy("l_suppkey", "list").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("status").isin(*gates.ATTENTION)).select("l_suppkey", "list", "place", "l_returnflag")


@query("""
SELECT p_brand, count(*) FILTER (WHERE p_partkey % 4 < 2) AS one, count(*) FILTER (WHERE p_partkey % 4 = 2) AS only_primer FROM part GROUP BY 1""")
def q_coat_parts(t):
    """Coats are told apart as numbers, however they are written."""
    coat = _pick(F.col("p_partkey"), ("1", "1.0", "1.5", "x")).try_cast("double")
    return t.part.groupBy("p_brand").agg(F.count_if(coat == 1).alias("one"), F.count_if(coat == 1.5).alias("only_primer"))


_LABELS = ("", " ", "ТЕХНО ОЗМ", "Taikor FP Epoxy", "TAIKOR FP Extra + TAIKOR FP Graphite", "taikor fp graphite", "taikor fp", "extra", "АКЗ", "озм", "краска", None)
_CODED = (
    f"{picked('p_partkey', _LABELS)} || {picked('p_partkey * 5 + p_size', ('', ' ', ' 2', ' + акз'))} AS label",
    f"{picked('p_size', ('со всех сторон', 'левая', 'Слева,', 'TOP', '', 'правая', None))} || {picked('p_partkey', ('', ' снизу', ' и сверху', ' bottom', ' RIGHT'))} AS sides",
    f"{picked('p_partkey * 3 + p_size', ('tube_sm', 'tube_sm_2', 'tube_sq', 'brands_', 'corner_e', 'I-beam_'))} AS shape",
    f"{picked('p_size', ('0', '1'))} AS method",
)
_COATS = ", ".join(f"({k}, '{name}', '{code}')" for k, (name, code) in enumerate(gates.COATS))


@query(f"""
WITH r AS (SELECT p_partkey, {', '.join(_CODED)} FROM part), k AS (SELECT p_partkey, lower(trim(coalesce(label, ''))) AS k, lower(coalesce(sides, '')) AS s, shape, method FROM r), coats(place, name, code) AS (VALUES {_COATS}),
m AS (SELECT p_partkey, arg_min(code, CASE WHEN name = k THEN place - 100 ELSE place END) AS code FROM k JOIN coats ON k <> '' AND (contains(k, name) OR contains(name, k)) GROUP BY 1),
f AS (SELECT *, regexp_matches(s, 'лев|left') AS l, regexp_matches(s, 'верх|top') AS t, regexp_matches(s, 'прав|right') AS r, regexp_matches(s, 'низ|bottom') AS b FROM k)
SELECT p_partkey, coalesce(code, '1') AS coat, l OR NOT (t OR r OR b) AS "left", t OR NOT (l OR r OR b) AS top, r OR NOT (l OR t OR b) AS "right", b OR NOT (l OR t OR r) AS bottom,
  CASE WHEN starts_with(shape, 'tube_sm') AND method = '0' THEN 3 WHEN starts_with(shape, 'brands') OR starts_with(shape, 'corner') THEN 2 ELSE 1 END AS lining FROM f LEFT JOIN m USING (p_partkey)""")
def q_prefill_codes(t):
    """Labels, free text on sides, and lining, as codes."""
    rows = t.part.selectExpr("p_partkey", *_CODED)
    side = gates.heated_sides(F.col("sides"))
    return rows.select("p_partkey", gates.coat_code(F.col("label")).alias("coat"), *(side[x].alias(x) for x in ("left", "top", "right", "bottom")), gates.lining(F.col("shape"), F.col("method")).alias("lining"))


@query("""
WITH m AS (SELECT page_id, length(html) > 3500 AS large, greatest((length(html) - length(replace(html, '<p>', ''))) // 3 - 6, 0) AS lines, length(html) - length(replace(html, 'ñ', '')) AS glyphs,
  (length(html) - length(replace(html, 'ough', ''))) // 4 AS images FROM pages)
SELECT page_id, CASE WHEN large AND (lines > 0 OR glyphs > 0) THEN 'mixed' WHEN large THEN 'raster' WHEN lines > 0 OR glyphs > 0 THEN 'vector' WHEN images > 0 THEN 'raster' ELSE 'empty' END AS kind FROM m""")
def q_page_kind(t):
    """A page's kind by what it holds; paragraphs stand for lines, a letter for glyphs, a syllable for images."""
    times = lambda x: F.floor((F.length("html") - F.length(F.replace("html", F.lit(x), F.lit("")))) / len(x))
    return t.pages.select("page_id", gates.page_kind(times("ough"), F.length("html") > 3500, F.greatest(times("<p>") - 6, F.lit(0)), times("ñ")).alias("kind"))


_ROLES = ("element_mass", "total_mass", "position", "unknown", "profile_size", "note")


@query(f"""
WITH r AS (SELECT l_orderkey, {_list(_ROLES)}[l_suppkey % 6 + 1] AS role FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(role = 'element_mass') AND bool_or(role = 'total_mass') AND bool_or(role IN ('position', 'profile_size')) THEN 'spec_main' ELSE 'generic' END AS kind FROM r GROUP BY 1""")
def q_table_kind(t):
    return gates.table_kind(t.lineitem.select("l_orderkey", _pick(F.col("l_suppkey"), _ROLES).alias("role")), "l_orderkey", "role")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'b=30.0|h=30.0' WHEN 1 THEN 'd=' || p_size || '.0|h=' || p_size || '.0|s=4.0' WHEN 2 THEN 'B=50.0|h=50.0|s=6.0|t=6.0' ELSE 'S1=0.0|S2=9.0|tr=9.0' END AS dims FROM part""")
def q_full_dims(t):
    """Names of dimensions by shape; the answer is known from how rows were made."""
    k, d, size = F.col("p_partkey") % 4, F.lit, F.col("p_size").cast("double")
    shape = _pick(F.col("p_partkey"), ("tube_sq", "tube_sm", "corner_e", "brands_"))
    raw = F.when(k == 0, F.create_map(d("A"), d(30.0))).when(k == 1, F.create_map(d("d"), size, d("h"), d(4.0))).when(k == 2, F.create_map(d("B"), d(50.0), d("t"), d(6.0))).otherwise(F.create_map(d("S1"), d(0.0), d("S2"), d(9.0)))
    rows = t.part.select("p_partkey", shape.alias("shape"), raw.alias("raw"))
    named = F.map_filter(gates.full_dims(F.col("shape"), F.col("raw")), lambda key, _: key != "A")
    return rows.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(named)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("dims"))


@query("""
WITH n AS (SELECT s_suppkey * 20 AS k, s_name AS name, CASE WHEN s_nationkey < 12 THEN 'book' ELSE 'own' END AS source FROM supplier)
SELECT c_custkey AS k, c_name AS name, c_mktsegment AS source FROM customer WHERE c_custkey NOT IN (SELECT k FROM n WHERE source = 'book') UNION ALL SELECT * FROM n WHERE source = 'book'""")
def q_source_merge(t):
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source"))
    new = t.supplier.select((F.col("s_suppkey") * 20).alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") < 12, "book").otherwise("own").alias("source"))
    return gates.source_merge(old, new, ["k"], "source", "book")


@query("""
WITH c AS (SELECT p_brand, p_type, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, p_type AS sheet, n, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place FROM c""")
def q_sheet_order(t):
    """Sheets come in the order in which a row first asks for them."""
    by = t.part.groupBy("p_brand", F.col("p_type").alias("sheet")).agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n"))
    return by.select("p_brand", "sheet", "n", F.row_number().over(W.partitionBy("p_brand").orderBy("first")).cast("bigint").alias("place"))


@query("""
WITH f AS (SELECT l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
SELECT p_partkey, CASE WHEN abs(l_quantity - p_size) <= 1e-6 THEN l_extendedprice END AS area FROM part LEFT JOIN f ON l_partkey = p_partkey AND n = 1""")
def q_verified_area(t):
    """A tabulated value counts only if the first row of its key has the same dimensions; later rows are not asked."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))
    table = t.lineitem.groupBy("l_partkey").agg(first.alias("f"))
    same = F.abs(F.col("f.l_quantity") - F.col("p_size")) <= 1e-6
    return t.part.join(table, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.when(same, F.col("f.l_extendedprice")).alias("area"))


_TITLE = " || ' ' || ".join((picked("p_partkey", ("Балки", "КОЛОННЫ", "Связи по", "ограждения", "Прочее", "", "Фахверк", "Стены", "лестниц,")), picked("p_partkey * 3 + p_size", ("", "покрытия", "Ограждений", "площадок и ферм", "балка")), picked("p_size", ("", " ", "кг")))) + " AS title"


@query(f"""
WITH t AS (SELECT p_partkey, lower(trim({_TITLE.removesuffix(' AS title')})) AS n FROM part), k AS (SELECT *, regexp_matches(n, '{'|'.join(classify.COUNTED)}') AS yes, regexp_matches(n, '{'|'.join(classify.EXCLUDED)}') AS no FROM t)
SELECT p_partkey, yes OR (NOT no AND n <> '') AS counted, (yes AND no) OR (NOT yes AND NOT no AND n <> '') AS mixed FROM k""")
def q_construction_columns(t):
    """Columns of masses by their title: an unknown one counts and is checked, a blank one does not count."""
    rows = t.part.selectExpr("p_partkey", _TITLE).withColumn("title", F.trim("title"))
    k = classify.keywords(F.col("title"), classify.COUNTED, classify.EXCLUDED)
    unknown = ~k["counted"] & ~k["excluded"] & (F.col("title") != "")
    return rows.select("p_partkey", (k["counted"] | unknown).alias("counted"), (k["mixed"] | unknown).alias("mixed"))


_GROUP_NAMES = ("Двутавры ", "Швеллеры ", "швеллер  гнутый", "Уголки ", "УГОЛОК гнутый ", "Профиль квадратный ", "квадратный", "Прямоугольный ", "трубы ", "Труба ВГП", "Арматура ", "Шестигранник", "плоскоовальные", "водогазопроводные", "", None)
_OTHERS = ("", "гнутые", "замкнутые", "трубы", "профили", "балки")
_CODES = ("ГОСТ Р 57837-2017", "СТО АСЧМ 20-93", "ГОСТ 8509-93", "ГОСТ 19771-93", "гост 8240", "ГОСТ 30245-2012", "ТУ 14", "", None)
_SERIES = ("Б1", "Ш", "К12", "П", "У", "Э1", ".5Б2", ".5П", "Х5", "б1", None)
_GROUPED = (f"{picked('p_partkey', _GROUP_NAMES)} || {picked('p_partkey * 5 + p_size', _OTHERS)} AS name", f"{picked('p_partkey * 7 + p_size * 3', _CODES)} AS standard", f"p_size || {picked('p_partkey * 3 + p_size', _SERIES)} AS mark")
_RULES = ", ".join(f"({k}, '{slug}', {_list(every)}::VARCHAR[], {_list(some)}::VARCHAR[])" for k, (slug, every, some) in enumerate(classify.CATEGORY_RULES))
_NUMBERS = ", ".join(f"({k}, '{slug}', '{code}')" for k, (slug, code) in enumerate(classify.STANDARD_RULES))


@query(f"""
WITH g AS (SELECT p_partkey, {', '.join(_GROUPED)} FROM part), rules(place, slug, needed, one_of) AS (VALUES {_RULES}), codes(place, slug, code) AS (VALUES {_NUMBERS}),
n AS (SELECT p_partkey, arg_min(slug, place) AS slug FROM g JOIN rules ON len(list_filter(needed, lambda w: NOT contains(lower(name), w))) = 0 AND (len(one_of) = 0 OR len(list_filter(one_of, lambda w: contains(lower(name), w))) > 0) WHERE name IS NOT NULL GROUP BY 1),
s AS (SELECT p_partkey, arg_min(slug, place) AS slug FROM g JOIN codes ON contains(lower(standard), code) GROUP BY 1)
SELECT p_partkey, coalesce(n.slug, s.slug, CASE WHEN regexp_matches(mark, '^[0-9]+([.][0-9]+)?[БШКМД][0-9]*$') THEN 'balka' WHEN regexp_matches(mark, '^[0-9]+([.][0-9]+)?[ПУЭ]$') THEN 'shveller' ELSE '' END) AS category
FROM g LEFT JOIN n USING (p_partkey) LEFT JOIN s USING (p_partkey)""")
def q_resolved_category(t):
    """The category of a profile by its group's name, its standard, or its mark."""
    return t.part.selectExpr("p_partkey", *_GROUPED).select("p_partkey", classify.resolved_category(F.col("name"), F.col("standard"), F.col("mark")).alias("category"))
