"""Lookups: as-of, nearest, layered, by alias, by tolerance, by ordinal, by overlap."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.operators import lookup

from .base import query

TIERS = (50000.0, 100000.0, 200000.0, 300000.0)


@query("""
SELECT o_orderkey, coalesce((SELECT max(b) FROM (VALUES (50000.0), (100000.0), (200000.0), (300000.0)) t(b) WHERE b <= o_totalprice), 50000.0)::DOUBLE AS tier FROM orders""")
def q_asof_floor(t):
    return t.orders.select("o_orderkey", lookup.floor_of(F.col("o_totalprice"), TIERS).alias("tier"))


@query("""
SELECT o_orderkey, (SELECT r.o_totalprice FROM orders r WHERE r.o_custkey = l.o_custkey AND r.o_orderstatus = 'F' AND r.o_orderdate <= l.o_orderdate ORDER BY r.o_orderdate DESC, r.o_orderkey DESC LIMIT 1) AS last_price
FROM orders l WHERE o_orderstatus = 'O'""")
def q_asof_join(t):
    """The customer's last filled order at the date of each open one."""
    left = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    right = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("r_key"), F.col("o_totalprice").alias("last_price"))
    return lookup.asof(left, right, ["o_custkey"], "o_orderdate", ["r_key"], ["last_price"]).select("o_orderkey", "last_price")


@query("""
SELECT p_partkey, (SELECT v FROM (VALUES (0, 905.0), (1, 925.0), (2, 950.0), (3, 985.0)) t(k, v) ORDER BY abs(p_retailprice - v), k LIMIT 1)::DOUBLE AS near FROM part""")
def q_nearest(t):
    return t.part.select("p_partkey", lookup.nearest(F.col("p_retailprice"), (905.0, 925.0, 950.0, 985.0)).alias("near"))


RATES = {("A", "F"): ((0.02, 1.0), (0.04, 2.0), (0.06, 3.0), (0.08, 4.0)), ("N", "O"): ((0.01, 1.5), (0.05, 2.5), (0.09, 3.5))}


@query("""
WITH r(f, s, a, rate, k) AS (VALUES ('A','F',0.02::DOUBLE,1.0::DOUBLE,0),('A','F',0.04,2.0,1),('A','F',0.06,3.0,2),('A','F',0.08,4.0,3),('N','O',0.01,1.5,0),('N','O',0.05,2.5,1),('N','O',0.09,3.5,2))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((SELECT rate FROM r WHERE f = l_returnflag AND s = l_linestatus AND a <= l_discount ORDER BY a DESC LIMIT 1),
       (SELECT rate FROM r WHERE f = l_returnflag AND s = l_linestatus ORDER BY k DESC LIMIT 1)) AS rate FROM lineitem""")
def q_nested_asof(t):
    """A dictionary for each pair of flags; below its first row its last one holds."""
    rate = F.lit(None).cast("double")
    for (flag, status), rows in RATES.items():
        rate = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), lookup.nested_floor(F.col("l_discount"), rows)).otherwise(rate)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rate.alias("rate"))


@query("""
WITH own AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
nat AS (SELECT c_nationkey, max(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 GROUP BY 1)
SELECT c_custkey, coalesce(own.v, nat.v, 0.0) AS value, CASE WHEN own.v IS NOT NULL THEN 'own' WHEN nat.v IS NOT NULL THEN 'nation' ELSE 'default' END AS source
FROM customer c LEFT JOIN own ON o_custkey = c_custkey LEFT JOIN nat ON nat.c_nationkey = c.c_nationkey""")
def q_layered_lookup(t):
    own = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    nation = t.customer.where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("v")).withColumnRenamed("c_nationkey", "nk")
    base = t.customer.select("c_custkey", F.col("c_custkey").alias("o_custkey_"), F.col("c_nationkey").alias("nk"))
    layers = [("own", own.withColumnRenamed("o_custkey", "o_custkey_"), "o_custkey_", "v"), ("nation", nation, "nk", "v")]
    return lookup.layered(base, layers, F.lit(0.0)).select("c_custkey", "value", "source")


@query("""
WITH c AS (SELECT c_mktsegment, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS owner FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY owner ASC NULLS LAST, c_custkey) AS n FROM c)
SELECT c_mktsegment, c_custkey, owner FROM k WHERE n = 1""")
def q_owner_override(t):
    """An owner's row goes before a global one; a minimum of structs, so that no group is sorted whole."""
    rows = t.customer.select("c_mktsegment", "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("owner"))
    return lookup.first_by(rows, ["c_mktsegment"], [F.col("owner").isNull(), F.col("owner"), F.col("c_custkey")])


@query("""
SELECT p_name || '|' || p_type || '|' || p_size AS mark, min(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""")
def q_unambiguous_key(t):
    """Marks that occur with one brand only."""
    mark = F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")).alias("mark")
    by = t.part.groupBy(mark).agg(F.min("p_brand").alias("brand"), F.max("p_brand").alias("other"))
    return by.where("brand = other").select("mark", "brand")


@query("""
WITH b AS (SELECT p_partkey, unnest([p_brand || '/' || p_size, p_name]) AS alias FROM part),
k AS (SELECT alias, min(p_partkey) AS hit FROM b GROUP BY 1),
p AS (SELECT p_partkey, unnest([p_brand || '/' || (p_size + 1), p_name || '?', p_name]) AS alias, unnest([0, 1, 2]) AS ord FROM part),
h AS (SELECT p_partkey, hit, row_number() OVER (PARTITION BY p_partkey ORDER BY hit IS NULL, ord) AS n FROM p LEFT JOIN k USING (alias))
SELECT p_partkey, hit FROM h WHERE n = 1""")
def q_alias_join(t):
    size = F.col("p_size").cast("string")
    build = t.part.select(F.col("p_partkey").alias("b_key"), F.array(F.concat("p_brand", F.lit("/"), size), "p_name").alias("aliases"))
    probe = t.part.select("p_partkey", F.array(F.concat("p_brand", F.lit("/"), (F.col("p_size") + 1).cast("string")), F.concat("p_name", F.lit("?")), F.col("p_name")).alias("aliases"))
    return lookup.alias_match(probe, build, "p_partkey", "b_key")


@query("""
SELECT p_brand, p_size, CASE WHEN count(DISTINCT p_retailprice) = 1 THEN min(p_retailprice) END AS price, count(*) AS hits FROM part GROUP BY 1, 2""")
def q_ambiguous_null(t):
    one = F.min("p_retailprice") == F.max("p_retailprice")
    return t.part.groupBy("p_brand", "p_size").agg(F.when(one, F.min("p_retailprice")).alias("price"), F.count(F.lit(1)).alias("hits"))


@query("""
WITH cat AS (SELECT DISTINCT p_brand, p_size FROM part),
c AS (SELECT p_partkey, p_brand, unnest([p_size + 1, p_size - 1, p_size + 40]) AS size FROM part),
h AS (SELECT p_partkey, count(*) AS n, min(size) AS size FROM c JOIN cat ON cat.p_brand = c.p_brand AND cat.p_size = c.size GROUP BY 1)
SELECT p.p_partkey, CASE WHEN n = 1 THEN size END AS size, coalesce(n, 0) AS hits FROM part p LEFT JOIN h ON h.p_partkey = p.p_partkey""")
def q_candidate_unique(t):
    """Of some candidate spellings the one that the catalog has, if it has one only."""
    known = t.part.select("p_brand", F.col("p_size").alias("size")).distinct()
    asked = t.part.select("p_partkey", "p_brand", F.explode(F.array(F.col("p_size") + 1, F.col("p_size") - 1, F.col("p_size") + 40)).alias("size"))
    got = asked.join(known.withColumn("known", F.col("size")), ["p_brand", "size"], "left").groupBy("p_partkey").agg(F.count("known").alias("hits"), F.min("known").alias("s"))
    return got.select("p_partkey", F.when(F.col("hits") == 1, F.col("s")).alias("size"), "hits")


@query("""
SELECT p_partkey, (SELECT k FROM (VALUES (0, 0, 903.0::DOUBLE), (1, 1, 950.0), (2, 0, 905.0), (3, 2, 990.0)) t(k, m, v) WHERE m = p_size % 4 AND abs(p_retailprice - v) <= 0.005 * v ORDER BY k LIMIT 1) AS hit FROM part""")
def q_tolerance_join(t):
    """Equal key and a value within half a per cent; the first hit. The cells of a hash join, then the band."""
    known = t.values("k int, m int, v double", [(0, 0, 903.0), (1, 1, 950.0), (2, 0, 905.0), (3, 2, 990.0)])
    rows = t.part.select("p_partkey", (F.col("p_size") % 4).alias("m"), "p_retailprice").join(F.broadcast(known), "m", "left")  # four fixed rows
    near = F.abs(F.col("p_retailprice") - F.col("v")) <= 0.005 * F.col("v")
    return rows.groupBy("p_partkey").agg(F.min(F.when(near, F.col("k"))).alias("hit"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def q_semi(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_anti(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.n AS ordinal, u.turn AS asked, a.turn AS answered FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.n = u.n""")
def q_zip_ordinal(t):
    """The i-th question with the i-th answer."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: t.conversations.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name), n.cast("bigint").alias("ordinal"))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "ordinal"], "left")


@query("""
WITH g AS (SELECT o_custkey % 50 AS grp, unnest([o_orderkey + 2, o_orderkey + 1]) AS row_id, unnest([0, 1]) AS pos, o_orderkey FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY grp, o_orderkey, pos) AS n FROM g)
SELECT o.o_orderkey, k.grp FROM orders o LEFT JOIN k ON k.row_id = o.o_orderkey AND n = 1""")
def q_first_claim(t):
    """A row belongs to the first group that lists it; rows that no group lists come with none."""
    groups = t.orders.select((F.col("o_custkey") % 50).alias("grp"), "o_orderkey", F.array(F.col("o_orderkey") + 2, F.col("o_orderkey") + 1).alias("ids"))
    listed = groups.select("grp", F.col("o_orderkey").alias("at"), F.posexplode("ids").alias("pos", "o_orderkey"))
    claimed = listed.groupBy("o_orderkey").agg(F.min(F.struct("grp", "at", "pos"))["grp"].alias("grp"))
    return t.orders.select("o_orderkey").join(claimed, "o_orderkey", "left")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 600 + event_id % 1800 AS b FROM events)
SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b""")
def q_range_overlap(t):
    rows = t.events.select("user_id", "event_id", F.unix_timestamp("ts").alias("s")).withColumn("e", F.col("s") + 600 + F.col("event_id") % 1800)
    return lookup.overlapping(rows, "user_id", "event_id", "s", "e", 2400)


@query("""
WITH cat AS (SELECT p_partkey AS ord, 'id' || (p_partkey * 2) AS id, p_brand, p_size FROM part)
SELECT p_partkey, (SELECT min(ord) FROM cat WHERE cat.id = 'id' || p.p_partkey OR (cat.p_brand = p.p_brand AND cat.p_size = p.p_size + 1)) AS hit FROM part p""")
def q_or_lookup(t):
    """By id, or by shape and label, the first in catalog order: two equal joins in place of one with OR."""
    cat = t.part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("id"), (F.col("p_partkey") * 2).cast("string")).alias("id"), "p_brand", "p_size")
    by_id, by_label = cat.groupBy("id").agg(F.min("ord").alias("o1")), cat.groupBy("p_brand", "p_size").agg(F.min("ord").alias("o2"))
    rows = t.part.select("p_partkey", "p_brand", (F.col("p_size") + 1).alias("p_size"), F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("id"))
    return rows.join(by_id, "id", "left").join(by_label, ["p_brand", "p_size"], "left").select("p_partkey", F.least("o1", "o2").alias("hit"))


@query("""
WITH m(s) AS (VALUES ('ring'), ('bolt'), ('red'))
SELECT p_partkey, (SELECT min(s) FROM m WHERE contains(p_name, s) AND NOT regexp_matches(p_name, '[0-9]')) AS hit FROM part""")
def q_soft_contains(t):
    """Names without digits may match by what they contain; the known names are three."""
    hit = F.array_min(F.filter(F.array(F.lit("ring"), F.lit("bolt"), F.lit("red")), lambda s: F.contains(F.col("p_name"), s)))
    return t.part.select("p_partkey", F.when(~F.col("p_name").rlike("[0-9]"), hit).alias("hit"))
