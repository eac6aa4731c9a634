"""Catalog versions, reshaping, rules, text functions, search and components over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.functions import text
from girder.functions.rounding import scaled
from girder.operators import classify, fuzzy, graph, merge, reshape
from girder.operators.lookup import first_by

from .base import picked, query


# ---- versions
@query("""
WITH d AS (SELECT doc_id, source, n_chars, sha256(lower(trim(text))) AS k, CAST(substr(source, 4) AS INT) % 5 AS prio FROM documents)
SELECT k, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio DESC, n_chars DESC, doc_id) AS n FROM d) WHERE n = 1""")
def q_priority_dedup(t):
    """One row of each text: highest source priority, then the longest, then the first. Texts travel as digests."""
    rows = t.documents.select("doc_id", "source", "n_chars", F.sha2(F.lower(F.trim("text")), 256).alias("k"), (F.substring("source", 4, 9).cast("int") % 5).alias("prio"))
    return merge.by_priority(rows, ["k"], [-F.col("prio"), -F.col("n_chars"), F.col("doc_id")]).select("k", "doc_id", "source")


@query("""
WITH o AS (SELECT c_custkey, c_acctbal, c_mktsegment AS source, c_custkey AS ord FROM customer),
n AS (SELECT s_suppkey * 20 AS c_custkey, s_acctbal AS c_acctbal, CASE WHEN s_nationkey < 12 THEN 'BUILDING' ELSE 'FURNITURE' END AS source, s_suppkey AS ord FROM supplier)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.source IS NULL OR o.source = n.source THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal,
  CASE WHEN o.source IS NULL OR o.source = n.source THEN n.source ELSE o.source END AS source, CASE WHEN o.source IS NULL THEN 'inserted' WHEN o.source = n.source THEN 'updated' ELSE 'kept' END AS state,
  (o.source IS NULL)::INT AS block, coalesce(o.ord, n.ord) AS ord FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def q_keyed_merge(t):
    old = t.customer.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("ord"))
    source = F.when(F.col("s_nationkey") < 12, "BUILDING").otherwise("FURNITURE")
    new = t.supplier.select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), source.alias("source"), F.col("s_suppkey").alias("ord"))
    return merge.keyed_merge(old, new, ["c_custkey"], ["c_acctbal"], "source", "ord")


@query("""
SELECT c_custkey, c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def q_patch(t):
    """Optional fields of a patch over its base."""
    patch = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return merge.patched(t.customer.select("c_custkey", "c_name", "c_acctbal"), patch, "c_custkey", ["c_name", "c_acctbal"])


@query("""
SELECT s_suppkey AS k, 'top' AS layer FROM supplier UNION ALL
SELECT c_custkey, 'under' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def q_shadow_union(t):
    top = t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("top").alias("layer"))
    return merge.shadowed(top, t.customer.select(F.col("c_custkey").alias("k"), F.lit("under").alias("layer")), "k")


@query("""
SELECT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal >= 3000""")
def q_set_difference(t):
    """Keys that a version of the catalog without its poorest rows has lost."""
    keys = ["c_nationkey", "c_mktsegment"]
    return t.customer.select(*keys).subtract(t.customer.where("c_acctbal >= 3000").select(*keys))


@query("""
WITH d AS (SELECT doc_id, lower(replace(regexp_replace(trim(' ' || upper(lang) || '  /  ' || source || ' '), '\\s+', ' ', 'g'), ' / ', '/')) AS key FROM documents)
SELECT key, min(doc_id) AS first, count(*) AS n FROM d GROUP BY 1""")
def q_autogroup(t):
    """Groups by a normalised name, in the order of first appearance."""
    name = F.concat(F.lit(" "), F.upper("lang"), F.lit("  /  "), F.col("source"), F.lit(" "))
    return merge.grouped_by_first(t.documents.select("doc_id", "lang", "source"), text.group_key(name), "doc_id")


@query("""
WITH c AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) || p_size AS canon FROM part)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY canon) > 1 THEN p_name ELSE canon END AS name FROM c""")
def q_collision_revert(t):
    """Canonical names that collide go back to the raw ones."""
    canon = t.part.select("p_partkey", "p_name", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size").cast("string")).alias("canon"))
    count = canon.groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    return canon.join(count, "canon").select("p_partkey", F.when(F.col("n") > 1, F.col("p_name")).otherwise(F.col("canon")).alias("name"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def q_first_occurrence(t):
    return first_by(t.events.select("event_type", "event_id"), ["event_type"], [F.col("event_id")])


# ---- reshaping
@query("""
SELECT l_orderkey, l_linenumber, l_partkey, element, mass FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['discount', 'tax']) AS element, unnest([l_discount, l_tax]) AS mass FROM lineitem) WHERE mass > 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'total', l_quantity FROM lineitem WHERE l_discount <= 0 AND l_tax <= 0""")
def q_unpivot(t):
    masses = F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"))
    return reshape.unpivoted(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], masses, F.col("l_quantity"))


@query("""
SELECT user_id, CAST(floor(event_id / 100) AS BIGINT) AS block, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error,
  CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view FROM events GROUP BY 1, 2 HAVING click + error + view > 0""")
def q_pivot_rows(t):
    """Cells by role to a column for each role."""
    rows = t.events.where("event_type in ('click', 'error', 'view')").select("user_id", F.floor(F.col("event_id") / 100).alias("block"), "event_type")
    wide = rows.groupBy("user_id", "block").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1)))
    return wide.fillna(0, ["click", "error", "view"])


@query("""
SELECT p_partkey, p_size + unnest(range(0, p_size % 3 + 1)) AS r, c FROM (SELECT p_partkey, p_size, unnest(range(0, p_partkey % 2 + 1)) + 1 AS c FROM part)""")
def q_span_expand(t):
    cells = t.part.select("p_partkey", F.col("p_size").cast("bigint").alias("row"), F.lit(1).cast("bigint").alias("col"), (F.col("p_size") % 3 + 1).alias("rs"), (F.col("p_partkey") % 2 + 1).alias("cs"))
    return reshape.covered(cells, "row", "col", "rs", "cs").select("p_partkey", "r", "c")


@query("""
WITH g AS (SELECT o_orderkey, unnest([1, 2]) AS gi, unnest([o_orderkey % 3, 2]) AS gq FROM orders), e AS (SELECT *, unnest([1, 2]) AS ei, unnest([0.0, gi + 1.0]) AS eq FROM g)
SELECT o_orderkey, 'g' || gi AS group_id, 'g' || gi || '-e' || ei AS element_id, CAST((CASE WHEN gq > 0 THEN gq ELSE 1 END) * (CASE WHEN eq > 0 THEN eq ELSE 1 END) AS DOUBLE) AS multiplier FROM e""")
def q_flatten(t):
    """Groups of elements to rows, ids by place, quantities multiplied."""
    element = lambda q: F.struct(F.lit(q).cast("double").alias("quantity"))
    group = lambda q, second: F.struct(q.cast("double").alias("quantity"), F.array(element(0), element(second)).alias("elements"))
    requests = t.orders.select("o_orderkey", F.array(group(F.col("o_orderkey") % 3, 2), group(F.lit(2), 3)).alias("groups"))
    return reshape.flattened(requests, "o_orderkey")


# ---- rules
@query("""
WITH f(facet, wanted) AS (VALUES ('a', 'red'), ('b', 'Brand#4'), ('c', ''), ('d', 'x/y'))
SELECT p_partkey, facet, CASE WHEN wanted = '' OR trim(v) = '' THEN TRUE WHEN contains(wanted, '/') THEN trim(v) = wanted ELSE list_contains(list_transform(string_split(trim(v), '/'), lambda x: trim(x)), wanted) END AS ok
FROM (SELECT p_partkey, facet, wanted, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE replace(p_name, ' ', ' / ') || '/' || p_brand END AS v FROM part, f)""")
def q_facet_filter(t):
    value = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit(" / ")), F.lit("/"), F.col("p_brand")))
    wanted = F.explode(F.create_map(*(F.lit(x) for pair in (("a", "red"), ("b", "Brand#4"), ("c", ""), ("d", "x/y")) for x in pair))).alias("facet", "wanted")
    return t.part.select("p_partkey", value.alias("v"), wanted).select("p_partkey", "facet", classify.facet_matches(F.col("v"), F.col("wanted")).alias("ok"))


@query("SELECT DISTINCT trim(unnest(string_split(replace(p_name, ' ', ' / ') || '/' || p_type, '/'))) AS value FROM part")
def q_facet_values(t):
    parts = F.split(F.concat(F.replace("p_name", F.lit(" "), F.lit(" / ")), F.lit("/"), F.col("p_type")), "/")
    return t.part.select(F.explode(parts).alias("v")).select(F.trim("v").alias("value")).distinct()


@query("""
WITH k AS (SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'bolt') OR contains(p_name, 'red') AS counted, contains(p_name, 'blue') OR contains(p_name, 'small') AS excluded,
  CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'red') THEN 'red' ELSE '' END AS matched FROM part)
SELECT p_partkey, counted, excluded, counted AND excluded AS mixed, matched FROM k""")
def q_classify(t):
    return t.part.select("p_partkey", classify.keywords(F.col("p_name"), ("ring", "bolt", "red"), ("blue", "small")).alias("k")).select("p_partkey", "k.*")


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget') THEN 'red-widget' WHEN contains(lower(p_name), 'ring') AND (contains(lower(p_name), 'small') OR contains(lower(p_name), 'blue')) THEN 'ring'
  WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'nut') THEN 'fastener' WHEN contains(lower(p_type), 'economy') THEN 'economy' ELSE '' END AS category FROM part""")
def q_rule_category(t):
    """Rules on the name in order, then on the type."""
    rules = (("red-widget", ("red", "widget"), ()), ("ring", ("ring",), ("small", "blue")), ("fastener", (), ("bolt", "nut")))
    return t.part.select("p_partkey", classify.category(F.col("p_name"), rules, classify.category(F.col("p_type"), (("economy", ("economy",), ()),), F.lit(""))).alias("category"))


@query("""
WITH s AS (SELECT p_partkey, p_size % 4 = 0 AS sheet, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_retailprice END AS mpm, contains(p_name, 'r') AS counted, contains(p_name, 'b') AS mixed FROM part)
SELECT p_partkey, CASE WHEN sheet AND mpm <= 0 THEN 'no_data' WHEN sheet THEN 'calculated' WHEN NOT counted THEN 'excluded' WHEN mpm <= 0 THEN 'no_data' WHEN mixed THEN 'needs_review' ELSE 'calculated' END AS status,
  CASE WHEN sheet OR NOT counted OR mpm <= 0 THEN 0.0 ELSE round(p_partkey / mpm * 100.0) / 100.0 END AS length FROM s""")
def q_status_machine(t):
    """Status of a form row; the sheet test comes before the keywords."""
    sheet, mpm = F.col("p_size") % 4 == 0, F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice"))
    counted, mixed = F.contains("p_name", F.lit("r")), F.contains("p_name", F.lit("b"))
    length = F.when(sheet | ~counted | (mpm <= 0), 0.0).otherwise(scaled(F.col("p_partkey") / mpm, 2))
    return t.part.select("p_partkey", classify.status(sheet, mpm, counted, mixed).alias("status"), length.alias("length"))


@query("""
WITH v AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size <= 25) AS thin FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN thin >= 2 AND thin >= 0.5 * n AND p_size <= 25 THEN 't' || p_size ELSE CAST(p_size AS VARCHAR) END AS size FROM part JOIN v USING (p_brand)""")
def q_group_vote(t):
    """A group whose sizes mostly look like thicknesses has those sizes rewritten."""
    vote = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") <= 25).alias("thin"))
    thin = (F.col("thin") >= 2) & (F.col("thin") >= 0.5 * F.col("n")) & (F.col("p_size") <= 25)
    size = F.col("p_size").cast("string")
    return t.part.select("p_partkey", "p_brand", "p_size").join(vote, "p_brand").select("p_partkey", F.when(thin, F.concat(F.lit("t"), size)).otherwise(size).alias("size"))


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey % 6 AS rw, count(DISTINCT l_linenumber) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, min(CASE WHEN n >= 3 AND lo = 1 THEN rw END) AS header FROM r GROUP BY 1""")
def q_header_rows(t):
    """The first row with three or more different numbers that begin at 1."""
    rows = t.lineitem.groupBy("l_suppkey", (F.col("l_orderkey") % 6).alias("rw")).agg(F.collect_set("l_linenumber").alias("s"))
    return rows.groupBy("l_suppkey").agg(F.min(F.when((F.size("s") >= 3) & (F.array_min("s") == 1), F.col("rw"))).alias("header"))


@query("""
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_returnflag = 'A') THEN 'ok' ELSE 'not_checked' END AS status FROM lineitem GROUP BY 1""")
def q_status_rollup(t):
    any_ = lambda x: F.bool_or(F.col("l_returnflag") == x)
    return t.lineitem.groupBy("l_orderkey").agg(F.when(any_("R"), "failed").when(any_("A"), "ok").otherwise("not_checked").alias("status"))


# ---- search
@query("""
WITH r AS (SELECT p_partkey, p_name, p_brand, CASE WHEN upper(p_name) = 'RED' THEN 0 WHEN starts_with(upper(p_name), 'RED') THEN 1 WHEN contains(upper(p_name), 'RED') THEN 2 END AS rank FROM part)
SELECT p_partkey, p_name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, (p_brand = 'Brand#4')::INT DESC, length(p_name), p_name, p_partkey LIMIT 12""")
def q_topk_search(t):
    """The twelve best: exact, prefix, inside; then the preferred brand, short names, names. A top-k, never a sort of all."""
    rows = t.part.select("p_partkey", "p_name", "p_brand", classify.search_rank(F.col("p_name"), "red").alias("rank")).where("rank is not null")
    order = ["rank", (F.col("p_brand") == "Brand#4").desc(), F.length("p_name"), "p_name", "p_partkey"]
    return rows.orderBy(*order).limit(12).select("p_partkey", "p_name", "rank")


@query("""
SELECT p_type, p_size, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) WHEN bool_or(p_brand = 'Brand#4') THEN 'Brand#4' END AS brand FROM part GROUP BY 1, 2""")
def q_exact_or_null(t):
    """An ambiguous hit is none, unless one is of the preferred category."""
    one = F.min("p_brand") == F.max("p_brand")
    return t.part.groupBy("p_type", "p_size").agg(F.when(one, F.min("p_brand")).when(F.bool_or(F.col("p_brand") == "Brand#4"), "Brand#4").alias("brand"))


@query("""
SELECT p_partkey, (SELECT w FROM (SELECT k, w, levenshtein(p_type, w) AS d FROM (VALUES (0, 'ECONOMI'), (1, 'SMAL'), (2, 'STANDART'), (3, 'PROMOTION')) t(k, w)) WHERE d <= 2 ORDER BY d, k LIMIT 1) AS near FROM part""")
def q_edit_argmin(t):
    return t.part.select("p_partkey", classify.closest(F.col("p_type"), ("ECONOMI", "SMAL", "STANDART", "PROMOTION"), 2).alias("near"))


# ---- text
@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || 'Б' || p_partkey % 4 WHEN 1 THEN p_size || 'Х' || p_size || 'Х5' ELSE p_size || 'П' END AS mark FROM part""")
def q_mark_normalize(t):
    """Marks with nouns, standards and Latin letters come out in one form; the answer is known from how they were made."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    beam = F.concat(F.lit("Двутавр "), size, F.lit("B"), (F.col("p_partkey") % 4).cast("string"), F.lit(" ГОСТ 26020-83"))
    angle = F.concat(F.lit(" уголок "), size, F.lit("x5 С255"))
    channel = F.concat(F.lit("Швеллер "), size, F.lit(" P ТУ 14"))
    raw = F.when(k == 0, beam).when(k == 1, angle).otherwise(channel)
    return t.part.select("p_partkey", text.three_number_angle(text.normal_mark(raw)).alias("mark"))


_SIGNS = ("", " ", "-", "+", "- ", "1 ", "12 0", "1\u00a0", "1\u202f00", "  2 3", "\t4", "\u00a0")
_ENDS = ("", " ", ",5", ".25 ", ",", "a", ",5a", " 000", "\u00a0000,7", " 00", " 123 456.5", "\u2009999 ", "  001", "-1", None)
_DIGITS = f"{picked('l_partkey', _SIGNS)} || l_suppkey || {picked('l_partkey * 3 + l_linenumber * 7', _ENDS)} AS raw"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_DIGITS} FROM lineitem), b AS (SELECT *, trim(regexp_replace(raw, '[ \t\u00a0\u2009\u202f]', ' ', 'g')) AS bare FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN regexp_matches(bare, '^[-+]?[0-9]+([.,][0-9]+)?$') OR regexp_matches(bare, '^[-+]?[0-9][0-9]?[0-9]?( [0-9][0-9][0-9])+([.,][0-9]+)?$')
  THEN CAST(replace(replace(bare, ' ', ''), ',', '.') AS DOUBLE) END AS n FROM b""")
def q_parse_number(t):
    """Decimal commas, blanks between thousands, and what is no number, of texts put together from parts."""
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _DIGITS).withColumn("n", text.number(F.col("raw"))).drop("raw")


_STANDARDS = ("ГОСТ ", "ГОСТ", "ГОСТ Р ", "ГОСТ  Р ", "ГОСТ Р", "СТО", "ТУ   ", "ОСТ ", "гост ", "по ")
_YEARS = ("-93", "-2017", "", "-9", ".1-97", "-20201", " -93")
_one = lambda a, b, n: f"{picked(a, _STANDARDS)} || {n} || {picked(b, _YEARS)}"
_PRINTED = " || ', ' || ".join((_one("p_partkey", "p_partkey * 3 + p_size", "p_size"), _one("p_partkey * 7 + p_size", "p_size", "8240"), _one("p_partkey", "p_partkey * 3 + p_size", "p_size"))) + " AS raw"


@query(f"""
WITH r AS (SELECT p_partkey, {_PRINTED} FROM part),
f AS (SELECT p_partkey, list_transform(regexp_extract_all(raw, '(?:ГОСТ Р|ГОСТ|СТО|ТУ) *[0-9][0-9.]*(?:-[0-9][0-9][0-9]?[0-9]?)?'),
  lambda x: regexp_extract(x, '^(ГОСТ Р|ГОСТ|СТО|ТУ)', 1) || ' ' || regexp_extract(x, '[0-9].*$')) AS l FROM r)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS found, regexp_extract(l[1], '([0-9][0-9.]*)-[0-9][0-9]', 1) AS number FROM f""")
def q_standards(t):
    """Standards in texts put together from parts: each once, in one spelling; the number of the first without its year."""
    found = text.standards(F.col("raw"))
    return t.part.selectExpr("p_partkey", _PRINTED).select("p_partkey", F.array_join(found, "|").alias("found"), text.standard_number(F.get(found, F.lit(0))).alias("number"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, sha256(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS bare FROM pages""")
def q_html_scrape(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.sha2(text.without_markup(F.col("html")), 256).alias("bare"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(1, p_size % 5 + 2), [7]))), ',') AS pages FROM part""")
def q_page_ranges(t):
    spec = F.concat(F.lit("1-"), (F.col("p_size") % 5 + 1).cast("string"), F.lit(", 7,x,7"))
    return t.part.select("p_partkey", F.array_join(text.pages(spec), ",").alias("pages"))


@query()
def q_json_salvage(t):
    """Whole objects out of JSON that breaks off; no SQL form."""
    broken = F.concat(F.lit('note {"rows": ['), F.col("props"), F.lit(', {"s": "a]}\\""}, {"cut": '), F.col("event_id").cast("string"))
    return t.events.select("event_id", fuzzy.salvaged(broken).alias("objects"))


@query()
def q_fuzzy_canon(t):
    """The nearest catalog word by sequence ratio; no SQL form."""
    return t.part.select("p_partkey", fuzzy.canonical(("smallring", "redwidget", "bluebolt", "economy"), 0.68)(F.col("p_name")).alias("canon"))


# ---- components
@query("""
WITH RECURSIVE up AS (SELECT c_custkey AS node, c_custkey AS here FROM customer UNION ALL
  SELECT node, CAST(floor(here / 2) AS BIGINT) FROM up JOIN customer ON c_custkey = here WHERE c_acctbal >= 2000 AND here > 0)
SELECT node AS c_custkey, min(here) AS component FROM up GROUP BY 1""")
def q_components(t):
    edges = t.customer.where("c_acctbal >= 2000").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"))
    return graph.components(t.customer.select("c_custkey"), edges, "c_custkey")


# ---- beyond parity: plain SQL breadth
@query("""
SELECT r_name, n_name, count(c_custkey) AS n, rank() OVER (PARTITION BY r_name ORDER BY count(c_custkey) DESC) AS place
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def q_ranked_nations(t):
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    by = rows.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("n"))
    return by.withColumn("place", F.rank().over(W.partitionBy("r_name").orderBy(F.desc("n"))).cast("bigint"))
