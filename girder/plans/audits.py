"""Smaller audits: grades of tables, tolerances, masses, titles, hints, free numbers, staged standards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.functions import text
from girder.functions.rounding import divided, half_even, scaled

from .base import query


@query("""
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 20) = 0 OR count(*) FILTER (WHERE l_quantity > 20 AND l_returnflag <> 'N') / count(*) FILTER (WHERE l_quantity > 20) >= 0.6 THEN 'unreadable' ELSE 'ok' END AS grade,
  count(*) FILTER (WHERE l_quantity > 20) AS cells FROM lineitem GROUP BY 1""")
def q_table_grade(t):
    """A table cannot be read if 0.6 of its filled cells are flagged, or none is filled."""
    filled = F.col("l_quantity") > 20
    cells = F.count_if(filled)
    share = F.count_if(filled & (F.col("l_returnflag") != "N")) / F.nullif(cells, F.lit(0))
    return t.lineitem.groupBy("l_orderkey").agg(F.when((cells == 0) | (share >= 0.6), "unreadable").otherwise("ok").alias("grade"), cells.alias("cells"))


@query("""
SELECT l_orderkey, count(*) AS terms, CASE WHEN abs(sum(CAST(l_quantity AS DECIMAL(18,2))) - 100) <= greatest(5.0, 2.0 * count(*)) THEN 'ok' ELSE 'failed' END AS status FROM lineitem GROUP BY 1""")
def q_tolerance_model(t):
    """The tolerance grows with the number of terms, from a floor."""
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)"))
    ok = F.abs(total - 100) <= F.greatest(F.lit(5.0), 2.0 * F.count(F.lit(1)))
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("terms"), F.when(ok, "ok").otherwise("failed").alias("status"))


@query("""
WITH m AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS kg, 7.85 * p_size AS per FROM part)
SELECT p_partkey, round(kg / per * 100.0) / 100.0 AS area, round(per * 1000.0) / 1000.0 AS per FROM m""")
def q_sheet_mass(t):
    """A sheet's mass a square metre from its thickness, read out of its mark, and its area."""
    thick = F.regexp_extract(F.concat(F.lit("Лист t="), F.col("p_size").cast("string"), F.lit(" мм")), r"([0-9]+(?:[.,][0-9]+)?)", 1).try_cast("double")
    rows = t.part.select("p_partkey", (7.85 * thick).alias("per"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") * 1000).otherwise(F.col("p_retailprice")).alias("kg"))
    return rows.select("p_partkey", scaled(divided(F.col("kg"), F.col("per")), 2).alias("area"), scaled(F.col("per"), 3).alias("per"))


@query("""
WITH k AS (SELECT p_brand, p_size, count(DISTINCT p_type) AS n, min(p_type) AS hint FROM part GROUP BY 1, 2)
SELECT p_brand, p_size, CASE WHEN n = 1 THEN hint END AS hint, n FROM k""")
def q_unique_hint(t):
    """A hint counts only if all rows give the same."""
    by = t.part.groupBy("p_brand", "p_size").agg(F.collect_set("p_type").alias("s"))  # as many as there are types at most
    return by.select("p_brand", "p_size", F.when(F.size("s") == 1, F.element_at("s", 1)).alias("hint"), F.size("s").cast("bigint").alias("n"))


@query("""
SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS title FROM conversations GROUP BY 1""")
def q_column_titles(t):
    """Texts of a column's head, from top to bottom."""
    heads = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("h"))
    return heads.select("conv_id", F.array_join(F.transform("h", lambda x: x["role"]), " ").alias("title"))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round_even(value / 20, 0), event_id) AS place FROM events""")
def q_reading_order(t):
    """Bands of twenty, then across; halves go to even bands."""
    band = half_even(F.col("value") / 20)
    return t.events.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(band, "event_id")).cast("bigint").alias("place"))


@query("""
WITH n AS (SELECT c_nationkey, c_custkey % 40 AS k FROM customer), t AS (SELECT c_nationkey, unnest(range(count(*) + 2)) AS k FROM n GROUP BY 1)
SELECT c_nationkey, min(k) AS free FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_nationkey = t.c_nationkey AND n.k = t.k) GROUP BY 1""")
def q_next_free(t):
    """The first free number of a group's titles."""
    taken = t.customer.select("c_nationkey", (F.col("c_custkey") % 40).alias("k"))
    tried = taken.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("c_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("k"))
    return tried.join(taken, ["c_nationkey", "k"], "left_anti").groupBy("c_nationkey").agg(F.min("k").alias("free"))


@query("""
WITH g AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events)
SELECT user_id, event_id, CAST(event_id + k * 100 AS BIGINT) AS point FROM g, range((SELECT CAST(max(event_id) / 100 + 2 AS BIGINT) FROM events)) r(k) WHERE k < greatest(1, coalesce(floor((gap + 50) / 100), 1))""")
def q_regular_pitch(t):
    """Points put in where a gap is about a multiple of the pitch."""
    gap = F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")) - F.col("event_id")
    times = F.greatest(F.lit(1), F.coalesce(F.floor((gap + 50) / 100), F.lit(1)))
    rows = t.events.select("user_id", "event_id", times.alias("n"))
    return rows.select("user_id", "event_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).select("user_id", "event_id", (F.col("event_id") + F.col("k") * 100).alias("point"))


@query("""
WITH cat AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice AS mass FROM part WHERE p_type <> 'ECONOMY'),
own AS (SELECT p_brand, p_type, p_size, count(DISTINCT mass) AS n, min(mass) AS mass FROM cat GROUP BY 1, 2, 3),
fam AS (SELECT p_brand, p_size, count(DISTINCT mass) AS n, min(mass) AS mass FROM cat GROUP BY 1, 2)
SELECT p.p_partkey, CASE WHEN own.n = 1 THEN own.mass WHEN own.n IS NULL AND fam.n = 1 THEN fam.mass END AS mass,
  CASE WHEN own.n = 1 THEN 'own' WHEN own.n IS NULL AND fam.n = 1 THEN 'family' WHEN own.n > 1 OR fam.n > 1 THEN 'ambiguous' ELSE 'none' END AS stage
FROM part p LEFT JOIN own ON own.p_brand = p.p_brand AND own.p_type = p.p_type AND own.p_size = p.p_size LEFT JOIN fam ON fam.p_brand = p.p_brand AND fam.p_size = p.p_size""")
def q_staged_standard(t):
    """By the row's own standard; without it by the family; several masses are none."""
    known = t.part.where("p_type <> 'ECONOMY'")
    masses = lambda keys, k: known.groupBy(*keys).agg((F.min("p_retailprice") == F.max("p_retailprice")).alias(f"one{k}"), F.min("p_retailprice").alias(f"m{k}"))
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    rows = rows.join(masses(["p_brand", "p_type", "p_size"], 1), ["p_brand", "p_type", "p_size"], "left").join(masses(["p_brand", "p_size"], 2), ["p_brand", "p_size"], "left")
    own, family = F.col("one1"), F.col("one1").isNull() & F.col("one2")
    stage = F.when(own, "own").when(family, "family").when(F.col("one1").isNotNull() | F.col("one2").isNotNull(), "ambiguous").otherwise("none")
    return rows.select("p_partkey", F.when(own, F.col("m1")).when(family, F.col("m2")).alias("mass"), stage.alias("stage"))


@query("""
SELECT p_partkey, 'b=' || p_size || '|h=' || (p_size + 1) AS signature FROM part""")
def q_map_signature(t):
    """Keys in order, whatever the order they came in."""
    dims = F.create_map(F.lit("h"), F.col("p_size") + 1, F.lit("b"), F.col("p_size"))
    return t.part.select("p_partkey", text.map_signature(dims).alias("signature"))


@query("""
SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS without_service, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS grand,
  coalesce(abs(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) - sum(CAST(l_quantity AS DECIMAL(18,2)))) <= 500, FALSE) AS ok FROM lineitem GROUP BY 1""")
def q_grade_total(t):
    """The total by grade, without service rows, against the grand total."""
    q = F.col("l_quantity").cast("decimal(18,2)")
    own, grand = F.sum(F.when(F.col("l_returnflag") != "R", q)), F.sum(q)
    return t.lineitem.groupBy("l_suppkey").agg(own.cast("double").alias("without_service"), grand.cast("double").alias("grand"), F.coalesce(F.abs(own - grand) <= 500, F.lit(False)).alias("ok"))


@query("""
SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 6 HOURS""")
def q_expired(t):
    """Jobs older than six hours at a given time; the filter reaches the scan."""
    return t.events.where(F.col("ts") < F.expr("timestamp_ntz'2024-01-10 00:00:00' - interval 6 hours")).select("event_id")
