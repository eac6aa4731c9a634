"""Edits of groups, gates, labels and lists of recognised rows, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.operators import edits

from .base import query, values
from .bills import T500

_LIST = "SELECT c_mktsegment AS doc, CAST(c_nationkey % 5 AS INT) AS block, c_custkey AS uid, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 5 ORDER BY c_custkey) AS ord, c_acctbal FROM customer"


def _list(t):
    """A document for each segment, of five blocks; block 0 holds elements without a group."""
    rows = t.customer.select(F.col("c_mktsegment").alias("doc"), (F.col("c_nationkey") % 5).cast("int").alias("block"), F.col("c_custkey").alias("uid"), "c_acctbal")
    return edits.renumbered(rows, ["doc"], "block", [F.col("uid")], "ord")


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE kind = 'item') AS items, count(*) FILTER (WHERE kind = 'sheet') AS sheets, CAST(coalesce(sum(l_quantity) FILTER (WHERE kind = 'item'), 0) AS BIGINT) AS metres FROM (
  SELECT l_orderkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'F' AND l_linenumber > 2 THEN 'sheet' WHEN l_quantity - 10 > 0 AND l_linenumber <> 2 AND l_linenumber <> 3 THEN 'item' END AS kind FROM lineitem) GROUP BY 1""")
def q_prefill_gate(t):
    """What goes to the calculator: counted rows with a length and a fire limit, and sheets."""
    status = F.when(F.col("l_returnflag") == "A", "Посчитано").when(F.col("l_returnflag") == "R", "Требует проверки").otherwise("Не считается")
    fire = F.when(F.col("l_linenumber") == 2, "  ").when(F.col("l_linenumber") != 3, F.concat(F.lit("R"), (15 * F.col("l_linenumber")).cast("string")))
    kind = edits.prefill_kind(status, (F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 2), F.col("l_quantity") - 10, fire)
    rows = t.lineitem.select("l_orderkey", "l_quantity", kind.alias("kind"))
    metres = F.coalesce(F.sum(F.when(F.col("kind") == "item", F.col("l_quantity").cast("bigint"))), F.lit(0))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("kind") == "item").alias("items"), F.count_if(F.col("kind") == "sheet").alias("sheets"), metres.alias("metres"))


@query(f"""
WITH l AS ({_LIST}), m AS (SELECT *, c_acctbal < 2000 AND block <> 3 AS goes FROM l)
SELECT doc, uid, CASE WHEN goes THEN 3 ELSE block END AS block, row_number() OVER (PARTITION BY doc, CASE WHEN goes THEN 3 ELSE block END ORDER BY goes, CASE WHEN goes THEN block ELSE 0 END, ord) AS ord FROM m""")
def q_group_moves(t):
    """Elements with a small balance go to the end of the third group."""
    return edits.moved(_list(t), ["doc"], "block", "ord", F.col("c_acctbal") < 2000, 3).select("doc", "uid", "block", "ord")


@query(f"""
WITH l AS ({_LIST})
SELECT doc, uid, CASE WHEN block = 2 THEN 0 WHEN block > 2 THEN block - 1 ELSE block END AS block, row_number() OVER (PARTITION BY doc, CASE WHEN block = 2 THEN 0 ELSE block END ORDER BY block, ord) AS ord FROM l""")
def q_group_removed(t):
    """The second group goes; its elements stay, without a group."""
    return edits.without_block(_list(t), ["doc"], "block", "ord", 2).select("doc", "uid", "block", "ord")


@query("""
WITH e AS (SELECT c_mktsegment AS doc, CASE WHEN c_nationkey < 3 THEN 0 ELSE c_nationkey END AS block FROM customer WHERE c_acctbal > 6000),
n AS (SELECT doc, block, count(*) AS elements FROM e GROUP BY 1, 2)
SELECT doc, CAST(block AS INT) AS block, CASE WHEN block = 0 THEN '' ELSE n_name END AS title, CASE WHEN block = 0 OR n_nationkey % 4 = 0 THEN 1 ELSE n_nationkey % 4 END AS quantity, elements FROM n LEFT JOIN nation ON n_nationkey = block""")
def q_block_plan(t):
    """Blocks of a request: none that is empty, those without a group first."""
    rows = t.customer.where("c_acctbal > 6000").select(F.col("c_mktsegment").alias("doc"), F.when(F.col("c_nationkey") < 3, 0).otherwise(F.col("c_nationkey")).alias("block"))
    titles = t.nation.select(F.col("n_nationkey").alias("block"), F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("title"), (F.col("n_nationkey") % 4).alias("quantity"))
    return edits.block_plan(rows, ["doc"], "block", titles)


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM lineitem), m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity FROM d
UNION ALL SELECT l_orderkey, top + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), l_quantity FROM d JOIN m USING (l_orderkey) WHERE l_quantity > 45""")
def q_duplicate_rows(t):
    """Chosen rows once more, under the next free numbers of their order."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    top = F.max("l_linenumber").over(W.partitionBy("l_orderkey"))
    more = rows.withColumn("top", top).where("l_quantity > 45")
    number = F.col("top") + F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity").unionByName(more.select("l_orderkey", number.cast("bigint").alias("l_linenumber"), "l_quantity"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS part, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, position, CASE WHEN coalesce(part, 1) = 1 THEN o_totalprice END AS o_totalprice, CASE WHEN coalesce(part, 1) = 1 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN n > 1 THEN 'row not separated by a ruling line; ' || n || ' positions share one cell' END AS note FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def q_split_positions(t):
    """Positions of a cell that no ruling divides."""
    cells = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("positions"))  # lines of one order
    rows = t.orders.join(cells, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice", "o_orderpriority", "positions")
    return edits.split_positions(rows, "positions", ["o_totalprice", "o_orderpriority"])


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE 'E%' THEN 'element:' || p_size WHEN p_type LIKE 'S%' THEN 'col' || p_size ELSE lower(p_type) END AS key FROM part""")
def q_column_keys(t):
    """Columns of elements and unknown ones by index, others by role."""
    role = F.when(F.col("p_type").startswith("E"), "element_mass").when(F.col("p_type").startswith("S"), "unknown").otherwise(F.lower("p_type"))
    return t.part.select("p_partkey", edits.column_key(role, F.col("p_size")).alias("key"))


@query(r"""
WITH r AS (SELECT conv_id, turn, turn // 2 AS grp, role = 'assistant' AS data, CASE WHEN length(text) % 3 > 0 THEN turn END AS position, CASE WHEN length(text) % 2 = 0 THEN lower(text) ELSE text END AS text FROM conversations),
f AS (SELECT conv_id, grp, trim(coalesce(text, '')) AS text FROM r WHERE data AND position IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT DISTINCT r.conv_id, r.grp, coalesce(f.grp = r.grp AND regexp_matches(f.text, '^\p{Ll}'), FALSE) AS continued FROM r LEFT JOIN f ON f.conv_id = r.conv_id""")
def q_continued_group(t):
    """Groups that go on from the block before: the first positioned row's name begins in lower case."""
    rows = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("grp"), (F.col("role") == "assistant").alias("data"), F.when(F.length("text") % 3 > 0, F.col("turn")).alias("position"), F.when(F.length("text") % 2 == 0, F.lower("text")).otherwise(F.col("text")).alias("text"))
    return edits.continued_groups(rows, ["conv_id"], "grp", ["turn"], F.col("data"), "position", "text")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ahead FROM orders WHERE o_orderstatus = 'O'""")
def q_queue_ahead(t):
    """How many jobs of a queue are ahead of each."""
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", (F.row_number().over(order) - 1).alias("ahead"))


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'PROMO', p_partkey) AS place FROM part""")
def q_legacy_last(t):
    """Rows without a standard come last, else the order stays."""
    order = W.partitionBy("p_brand").orderBy((F.col("p_type") == "PROMO").cast("int"), "p_partkey")
    return t.part.select("p_partkey", F.row_number().over(order).alias("place"))


@query(r"""
SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY url, page_id) AS place FROM pages""")
def q_page_files(t):
    """Pages of a host in the order of their names."""
    order = W.partitionBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).orderBy("url", "page_id")
    return t.pages.select("page_id", F.row_number().over(order).alias("place"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def q_recent_jobs(t):
    """The latest eight."""
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(8).select("event_id", "user_id")


_HREF = "split_part(url, '?', 1) || CASE page_id % 4 WHEN 0 THEN '?n' || (1700000000000 + page_id) WHEN 1 THEN '?a=1&n=n' || (1700000000000 + page_id) || '#top' WHEN 2 THEN '?n=n' || page_id ELSE '' END"


@query(rf"""
WITH h AS (SELECT page_id, regexp_extract({_HREF}, '\?([^#]*)', 1) AS s FROM pages), n AS (SELECT page_id, s, regexp_extract(s, '(?:^|&)n=([^&]*)', 1) AS n FROM h)
SELECT page_id, CASE WHEN regexp_matches(s, '^n\d{{13,17}}$') THEN s WHEN regexp_matches(n, '^n\d{{13,17}}$') THEN n END AS token FROM n""")
def q_by_token(t):
    """The token of a shared page's address, bare or named."""
    number = F.concat(F.lit("n"), (F.lit(1700000000000) + F.col("page_id")).cast("string"))
    tail = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("?"), number)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("?a=1&n="), number, F.lit("#top"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("?n=n"), F.col("page_id").cast("string"))).otherwise("")
    return t.pages.select("page_id", edits.share_token(F.concat(F.split_part("url", F.lit("?"), F.lit(1)), tail)).alias("token"))


@query("""
WITH a AS (SELECT event_id, epoch_ms(ts) // 60000 * 60000 AS ms FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY ms ORDER BY event_id) - 1 AS attempt FROM a)
SELECT event_id, 'n' || ms || CASE WHEN attempt = 0 THEN '' ELSE lpad(CAST(attempt % 1000 AS VARCHAR), 3, '0') END AS token FROM k""")
def q_share_token(t):
    """Tokens by time; a number is added where the time is taken."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", (ms - ms % 60000).alias("ms"))  # towards 1970, as whole numbers divide
    rows = rows.withColumn("attempt", F.row_number().over(W.partitionBy("ms").orderBy(F.col("event_id").asc_nulls_last())) - 1)
    return rows.select("event_id", edits.new_token(F.col("ms"), F.col("attempt")).alias("token"))


@query("""
WITH o AS (SELECT p_brand, list(DISTINCT p_size ORDER BY p_size) AS s FROM part WHERE p_size < 25 AND p_brand <> 'Brand#3' GROUP BY 1), a AS (SELECT p_brand, list(DISTINCT p_size ORDER BY p_size) AS s FROM part WHERE p_size % 3 = 0 GROUP BY 1)
SELECT p_brand, array_to_string(list_concat(coalesce(o.s, []), list_filter(coalesce(a.s, []), lambda x: NOT list_contains(coalesce(o.s, []), x))), ' ') AS shapes FROM o FULL JOIN a USING (p_brand)""")
def q_nested_union(t):
    """Families with the shapes they had, then the added ones; new families as they are."""
    sizes = lambda where: t.part.where(where).groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("s"))  # noqa: E731  a family's sizes
    old, added = sizes("p_size < 25 AND p_brand <> 'Brand#3'"), sizes("p_size % 3 = 0").withColumnRenamed("s", "more")
    none = F.array().cast("array<int>")
    both = F.array_union(F.coalesce("s", none), F.coalesce("more", none))
    return old.join(added, "p_brand", "full").select("p_brand", F.array_join(both.cast("array<string>"), " ").alias("shapes"))


_SHAPES = ("I-beam_sm", "channel_p", "corner_e", "corner_ue", "tube_sq", "profile_sq", "tube_sm", "sheet")


@query("""
WITH d AS (SELECT p_partkey, p_partkey % 8 AS k, 4.0::DOUBLE * p_size AS h, 2.0::DOUBLE * p_size + 3 AS b, 1.0::DOUBLE * (p_partkey % 7) AS t, 1.0::DOUBLE * (p_partkey % 13) AS r FROM part),
a AS (SELECT p_partkey, CASE
  WHEN k <= 1 THEN CASE WHEN h > 0 AND t > 0 THEN 2 * b * t + (h - 2 * t) * t + (CASE WHEN r > 0 THEN (CASE k WHEN 0 THEN 4 ELSE 2 END) * (1 - pi() / 4) * r * r ELSE 0 END) END
  WHEN k = 2 THEN CASE WHEN t > 0 THEN (2 * b - t) * t + (1 - pi() / 4) * r * r - 2 * (1 - pi() / 4) * (r / 2) * (r / 2) END
  WHEN k = 3 THEN CASE WHEN h > 0 AND t > 0 THEN (h + b - t) * t END
  WHEN k = 4 THEN CASE WHEN t > 0 AND 2 * t < h THEN 4 * (h - t) * t - (4 - pi()) * 3 * t * t END
  WHEN k = 5 THEN CASE WHEN h > 0 AND t > 0 THEN 2 * (h + b - 2 * t) * t - (4 - pi()) * 3 * t * t END
  WHEN k = 6 THEN CASE WHEN h > 0 AND 2 * h < 10 * b THEN pi() * (10 * b - h) * h WHEN h <= 0 AND t > 0 AND 2 * t < 10 * b THEN pi() * (10 * b - t) * t END END AS area FROM d)
SELECT p_partkey, round(area, 3) AS area FROM a""")
def q_fillet_area(t):
    """Areas of sections from their dimensions, fillets counted."""
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    h, b = 4.0 * F.col("p_size"), 2.0 * F.col("p_size") + 3
    thick, radius = 1.0 * (F.col("p_partkey") % 7), 1.0 * (F.col("p_partkey") % 13)
    dims = {"h": h, "b": b, "s": thick, "t": thick, "R": radius, "r": radius / 2, "B": h, "A": h, "d": 10 * b}
    return t.part.select("p_partkey", F.round(edits.section_area(shape, dims.__getitem__), 3).alias("area"))


@query("""
WITH c AS (SELECT p_partkey, p_retailprice, 30.0::DOUBLE * (p_size % 9) AS r, p_partkey % 3 = 0 AS bare FROM part),
d AS (SELECT *, CASE WHEN bare THEN CASE WHEN r >= 240 THEN 40 ELSE 50 END WHEN r = 180 THEN 55 WHEN r = 240 THEN 45 ELSE 50 END AS delta FROM c)
SELECT p_partkey, delta::DOUBLE AS delta, round(p_retailprice * (delta / 1000.0::DOUBLE) * 1.03::DOUBLE, 3) AS volume, CASE WHEN r >= 240 THEN 110 ELSE 80 END AS grade FROM d""")
def q_concrete(t):
    """Board for concrete: thickness by fire limit, from a map where there is one, volume and grade."""
    limit = 30.0 * (F.col("p_size") % 9)
    by_limit = F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.lit("180"), F.lit(55.0), F.lit("240"), F.lit(45.0)))
    rows = t.part.select("p_partkey", "p_retailprice", limit.alias("r"), edits.concrete_delta(limit, by_limit).alias("delta"))
    return rows.select("p_partkey", "delta", F.round(F.col("p_retailprice") * (F.col("delta") / 1000.0) * 1.03, 3).alias("volume"), F.when(F.col("r") >= 240, 110).otherwise(80).alias("grade"))


@query(f"""
WITH t500 AS (SELECT * FROM {values(list(T500), "x(base, a, m, thick)")}), p AS (SELECT p_partkey, 10.0::DOUBLE * (p_size % 12) AS thick, p_retailprice % 17 AS dpr FROM part),
f AS (SELECT p_partkey, dpr, base, a, m FROM p JOIN t500 USING (thick) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY base <= dpr DESC, CASE WHEN base <= dpr THEN -base ELSE base END) = 1)
SELECT p_partkey, round(coalesce(a * greatest(0, f.dpr - base) + m, 0), 6) AS minutes FROM p LEFT JOIN f USING (p_partkey)""")
def q_chart_limit(t):
    """Fire limit of a plate for the chart: as of the base below, never extrapolated downwards."""
    table = t.values("base double, a double, m double, thick double", list(T500))
    rows = t.part.select("p_partkey", (10.0 * (F.col("p_size") % 12)).alias("thickness"), (F.col("p_retailprice") % 17).alias("dpr"))
    return edits.chart_limit(rows, table, "thickness", "dpr").select("p_partkey", F.round("limit", 6).alias("minutes"))


@query("""
SELECT n.p_partkey FROM part n WHERE n.p_partkey % 2 = 1 AND EXISTS (SELECT 1 FROM part o WHERE o.p_partkey % 2 = 0 AND o.p_type = n.p_type AND abs(o.p_size - n.p_size) <= 0.5 AND abs(o.p_retailprice - n.p_retailprice) <= 0.5)""")
def q_alike_geometry(t):
    """New profiles whose shape and dimensions an old one has."""
    rows = t.part.select("p_partkey", "p_type", F.col("p_size").cast("double").alias("h"), F.col("p_retailprice").alias("b"))
    return edits.alike(rows.where("p_partkey % 2 = 1"), rows.where("p_partkey % 2 = 0"), "p_type", ["b", "h"], 0.5).select("p_partkey")


@query("""
SELECT l_orderkey, concat_ws('; ', CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN count(*) FILTER (WHERE l_returnflag = 'A') || ' by formula' END,
  CASE WHEN count(*) FILTER (WHERE l_quantity > 40) > 0 THEN count(*) FILTER (WHERE l_quantity > 40) || ' without a mass' END) AS notes FROM lineitem GROUP BY 1""")
def q_import_notes(t):
    """A sentence for each thing to look at, with its count."""
    counts = [(F.count_if(F.col("l_returnflag") == "A"), "%d by formula"), (F.count_if(F.col("l_quantity") > 40), "%d without a mass")]
    return t.lineitem.groupBy("l_orderkey").agg(edits.counted_notes(counts).alias("notes"))


@query("""
SELECT l_orderkey, round(min(l_discount) FILTER (WHERE l_tax > 0.02), 3) AS confidence FROM lineitem GROUP BY 1""")
def q_row_confidence(t):
    """The least sure of a row's cells that are not empty; null if all are."""
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.min(F.when(F.col("l_tax") > 0.02, F.col("l_discount"))), 3).alias("confidence"))


@query("""
SELECT n_regionkey, count(*) FILTER (WHERE n > 0) AS filled, count(*) AS groups FROM (
  SELECT n_regionkey, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1, 2) GROUP BY 1""")
def q_filled_groups(t):
    """How many groups have rows at all."""
    rows = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    groups = t.nation.join(rows, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return groups.groupBy("n_regionkey").agg(F.count_if(F.col("n") > 0).alias("filled"), F.count(F.lit(1)).alias("groups"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS mass, 100 * l_tax AS per, CASE WHEN l_linenumber % 3 = 0 THEN 1.5::DOUBLE END AS typed, CASE l_returnflag WHEN 'A' THEN 'Нужен ввод массы' WHEN 'R' THEN 'Нет данных' ELSE 'Требует проверки' END AS status FROM lineitem),
h AS (SELECT *, per > 0 AND typed IS NULL AND mass > 0 AS hit FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN hit THEN floor(mass / per * 100 + 0.5) / 100 ELSE typed END AS length_m, CASE WHEN hit THEN 'manual' ELSE 'handbook' END AS mass_source, CASE WHEN hit AND status <> 'Требует проверки' THEN 'Посчитано' ELSE status END AS status FROM h""")
def q_client_patch(t):
    """A typed mass per metre gives the length and closes an open row."""
    status = F.when(F.col("l_returnflag") == "A", "Нужен ввод массы").when(F.col("l_returnflag") == "R", "Нет данных").otherwise("Требует проверки")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 5).alias("mass"), (100 * F.col("l_tax")).alias("per"), F.when(F.col("l_linenumber") % 3 == 0, 1.5).alias("typed"), status.alias("status"))
    return edits.client_patch(rows, "mass", F.col("per"), F.col("typed")).select("l_orderkey", "l_linenumber", "length_m", "mass_source", "status")


@query("""
WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'glyph' ELSE 'pdf' END AS source, value / 400 AS confidence, CASE event_id % 5 WHEN 0 THEN '10°' WHEN 1 THEN ' ШИ ' WHEN 2 THEN '20' ELSE '70' END AS read, CASE WHEN event_id % 7 < 5 THEN ' 70' WHEN event_id % 7 = 5 THEN '71' END AS other FROM events)
SELECT event_id, CASE WHEN source <> 'pdf' AND confidence < 0.5 AND trim(read) IN ('10°', 'ШИ') AND trim(other) = '70' THEN '70' ELSE read END AS grade FROM r""")
def q_grade_recovery(t):
    """A lost grade comes back only if source, doubt and the second reading agree."""
    k = F.col("event_id")
    source = F.when(k % 3 == 0, "ocr").when(k % 3 == 1, "glyph").otherwise("pdf")
    read = F.when(k % 5 == 0, "10°").when(k % 5 == 1, " ШИ ").when(k % 5 == 2, "20").otherwise("70")
    other = F.when(k % 7 < 5, " 70").when(k % 7 == 5, "71")
    return t.events.select("event_id", edits.recovered_grade(read, source, F.col("value") / 400, read, other).alias("grade"))


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE ' R' || p_size * 3 END AS now FROM part), c AS (SELECT *, ['R15','R30','R45','R60','R90','R120','R150','R180','R210','R240'] AS canon FROM r)
SELECT p_partkey, array_to_string(CASE WHEN trim(now) <> '' AND NOT list_contains(canon, trim(now)) THEN list_prepend(trim(now), canon) ELSE canon END, ' ') AS choices FROM c""")
def q_limit_choices(t):
    """Fire limits to choose from; an unknown current one comes first."""
    now = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.lit(" R"), (F.col("p_size") * 3).cast("string")))
    return t.part.select("p_partkey", F.array_join(edits.choices(now), " ").alias("choices"))


@query("""
WITH r AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Балки' WHEN 1 THEN ' Связи' WHEN 2 THEN '' WHEN 3 THEN 'Колонны/Стойки' WHEN 4 THEN NULL WHEN 5 THEN 'Прогоны' WHEN 6 THEN 'Ригели' ELSE upper(p_name) END AS c, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand || ' ' END AS m FROM part),
l AS (SELECT p_partkey, trim(m) AS m, CASE trim(coalesce(c, '')) WHEN 'Колонны/Стойки' THEN 'колонна / стойка' WHEN 'Балки' THEN 'балка' WHEN 'Связи' THEN 'связь' WHEN 'Прогоны' THEN 'прогон' WHEN 'Ригели' THEN 'ригели' ELSE lower(trim(coalesce(c, ''))) END AS c FROM r)
SELECT p_partkey, CASE WHEN c = '' AND m = '' THEN 'Элемент' WHEN c = '' THEN m WHEN m = '' THEN c ELSE c || ' ' || m END AS name FROM l""")
def q_element_name(t):
    """An element's name from its construction and mark."""
    k = F.col("p_partkey") % 8
    names = {0: "Балки", 1: " Связи", 2: "", 3: "Колонны/Стойки", 4: None, 5: "Прогоны", 6: "Ригели"}
    construction = F.upper("p_name")
    for i, name in names.items():
        construction = F.when(k == i, F.lit(name)).otherwise(construction)
    mark = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat("p_brand", F.lit(" ")))
    return t.part.select("p_partkey", edits.element_name(construction, mark).alias("name"))


@query("""
SELECT p_partkey, 'files/products/' || p_partkey || '.png' AS image, 'files/nodes/' || replace(replace(p_name, ' ', '/'), '/', ' ') || '.pdf' AS nodes FROM part""")
def q_product_links(t):
    """Names of a product's files; a stroke in its name is a blank there."""
    name = F.translate("p_name", " ", "/")
    return t.part.select("p_partkey", F.concat(F.lit("files/products/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image"), F.concat(F.lit("files/nodes/"), F.replace(name, F.lit("/"), F.lit(" ")), F.lit(".pdf")).alias("nodes"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def q_request_echo(t):
    """A request as it is echoed: without its prices and dates."""
    return t.orders.drop("o_totalprice", "o_orderdate")


@query("""
WITH k AS (SELECT l_suppkey AS block, l_quantity AS x, l_orderkey % 400 AS y FROM lineitem WHERE l_orderkey % 7 < l_suppkey % 8),
xs AS (SELECT block, list(DISTINCT x ORDER BY x) AS xs FROM k GROUP BY 1), ys AS (SELECT block, list(DISTINCT y::DOUBLE ORDER BY y::DOUBLE) AS ys FROM k GROUP BY 1),
n AS (SELECT block, xs[1:block % 30 + 1] AS xs, ys[1:block % 41 + 1] AS ys FROM xs JOIN ys USING (block)),
g AS (SELECT *, len(ys) - 1 AS n_rows, len(xs) - 1 AS n_cols, [xs[i + 1] - xs[i] for i in range(1, len(xs))] AS gx, list_sort([ys[i + 1] - ys[i] for i in range(1, len(ys))]) AS gy FROM n),
m AS (SELECT *, list_avg(gx) AS mean FROM g),
d AS (SELECT *, sqrt(list_avg([(q - mean) * (q - mean) for q in gx])) / mean AS cv FROM m)
SELECT block, n_cols >= 20 OR (n_rows <= 6 AND n_cols >= 15) OR (n_rows >= 20 AND n_cols >= 8 AND coalesce(gy[len(gy) // 2 + 1] < 8, FALSE)) OR (n_cols >= 15 AND coalesce(cv >= 0.8, FALSE) AND coalesce(len(list_filter(gx, lambda q: q < 6)) / len(gx) >= 0.5, FALSE)) AS drawing,
  coalesce(xs[-1] - xs[1] > 0 AND ys[-1] - ys[1] > 0 AND (ys[-1] - ys[1] > 3 * (xs[-1] - xs[1]) OR xs[-1] - xs[1] > 8 * (ys[-1] - ys[1])), FALSE) AS stamp FROM d""")
def q_drawing_grid(t):
    """Blocks of rulings that are drawings or stamps, no tables."""
    rows = t.lineitem.where("l_orderkey % 7 < l_suppkey % 8").select(F.col("l_suppkey").alias("block"), F.col("l_quantity").alias("x"), (F.col("l_orderkey") % 400).cast("double").alias("y"))
    by = rows.groupBy("block").agg(F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"))  # 50 and 400 values at most
    by = by.select("block", F.slice("xs", F.lit(1), (F.col("block") % 30 + 1).cast("int")).alias("xs"), F.slice("ys", F.lit(1), (F.col("block") % 41 + 1).cast("int")).alias("ys"))
    size = lambda c: F.element_at(c, -1) - F.element_at(c, 1)
    return by.select("block", edits.drawing_grid(F.size("ys") - 1, F.size("xs") - 1, F.col("xs"), F.col("ys")).alias("drawing"), edits.stamp_block(size("xs"), size("ys")).alias("stamp"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) > 2, TRUE)::INT AS new FROM r WHERE x < 30),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY x RANGE UNBOUNDED PRECEDING) AS cluster FROM e),
m AS (SELECT l_orderkey, cluster, avg(x) AS centre, any_value(n) AS n FROM c GROUP BY 1, 2),
s AS (SELECT m.l_orderkey, m.centre, m.n, count(*) AS near FROM m JOIN e ON e.l_orderkey = m.l_orderkey AND abs(e.x - m.centre) <= 2 GROUP BY 1, 2, 3),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY near DESC, centre) = 1)
SELECT o.l_orderkey, CASE WHEN near >= greatest(2, floor(b.n * 0.25)) THEN centre END AS bound FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN b USING (l_orderkey)""")
def q_implied_bound(t):
    """A bound that no line draws, told by the ends of the lines across it."""
    by = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") < 30, F.col("l_quantity"))).alias("ends"), F.count(F.lit(1)).alias("n"))  # lines of one order
    return by.select("l_orderkey", edits.implied_bound(F.col("ends"), F.col("n"), 2.0).alias("bound"))
