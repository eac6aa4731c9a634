"""Reconciliation, carry-forward, gaps, intervals and streams' windows, all over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.functions.rounding import scaled
from girder.operators import ordered
from girder.streaming import rates

from .base import query

_ROWS = """
r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS v,
        CASE WHEN l_partkey % 11 = 0 THEN 'profile_total' WHEN l_partkey % 4 = 0 THEN 'group_total' ELSE 'data' END AS kind FROM lineitem),
g AS (SELECT *, coalesce(sum((kind <> 'data')::INT) OVER w, 0) AS sg, coalesce(sum((kind = 'profile_total')::INT) OVER w, 0) AS sp FROM r
      WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, coalesce(sum(CASE WHEN kind = 'data' THEN v END) OVER (PARTITION BY l_suppkey, sg), 0) AS data,
        max((kind = 'group_total')::INT) OVER (PARTITION BY l_suppkey, sg) AS closed FROM g),
p AS (SELECT *, coalesce(sum(CASE WHEN kind = 'group_total' THEN v WHEN kind = 'data' AND closed = 0 THEN v END) OVER (PARTITION BY l_suppkey, sp), 0) AS prof FROM d)"""


@query(f"""
WITH {_ROWS}
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, kind, v, CASE WHEN kind = 'group_total' THEN data ELSE prof END AS calculated,
  CASE WHEN abs(CASE WHEN kind = 'group_total' THEN data ELSE prof END - v) <= greatest(0.05, 0.01 * abs(v)) THEN 'ok' ELSE 'failed' END AS status
FROM p WHERE kind <> 'data'""")
def q_segment_reconcile(t):
    """Totals of two levels in each supplier's lines, made up by rule."""
    kind = F.when(F.col("l_partkey") % 11 == 0, "profile_total").when(F.col("l_partkey") % 4 == 0, "group_total").otherwise("data")
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("v"), kind.alias("kind"))
    tolerance = F.greatest(F.lit(0.05), 0.01 * F.abs("v"))
    return ordered.group_totals(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "v"], "kind", "v", tolerance)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity WHEN abs(l_tax + l_discount - 0.1) <= 0.05 THEN round((l_tax + l_discount) * 100.0) / 100.0 END AS effective FROM lineitem""")
def q_effective_total(t):
    """A blank total is replaced by what the row adds up to, only where the printed sum confirms it."""
    calc = F.col("l_tax") + F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).when(F.abs(calc - 0.1) <= 0.05, scaled(calc, 2)).alias("effective"))


@query("""
WITH c AS (SELECT conv_id, turn, turn % 5 = 4 AS reset, CASE WHEN turn % 3 = 0 THEN role END AS label FROM conversations),
s AS (SELECT *, sum(reset::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM c)
SELECT conv_id, turn, CASE WHEN NOT reset THEN last_value(CASE WHEN NOT reset THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS carried FROM s""")
def q_carry_forward(t):
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("label"))
    return ordered.carried(F.col("label"), F.col("turn") % 5 == 4, ["conv_id"], ["turn"], rows, "carried").select("conv_id", "turn", "carried")


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS v, turn + 2 AS row_end FROM conversations),
s AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'v': v, 'e': row_end} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS x FROM c)
SELECT conv_id, turn, CASE WHEN x.e > turn THEN x.v END AS value FROM s""")
def q_span_carry(t):
    """A merged cell's value holds as far as the cell reaches."""
    cell = F.when(F.col("turn") % 3 == 0, F.struct(F.col("role").alias("v"), (F.col("turn") + 2).alias("e")))
    seen = F.last(cell, ignorenulls=True).over(ordered.up_to(["conv_id"], ["turn"]))
    return t.conversations.select("conv_id", "turn", seen.alias("x")).select("conv_id", "turn", F.when(F.col("x.e") > F.col("turn"), F.col("x.v")).alias("value"))


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
v AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE k + (event_id % 11 = 0)::INT END AS pos FROM n),
ab AS (SELECT *, last_value(CASE WHEN pos IS NOT NULL THEN {'v': pos, 'n': k} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS a,
  first_value(CASE WHEN pos IS NOT NULL THEN {'v': pos, 'n': k} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM v)
SELECT event_id, CAST(coalesce(pos, CASE WHEN b.v - a.v = b.n - a.n THEN a.v + k - a.n END) AS BIGINT) AS filled FROM ab""")
def q_gap_fill(t):
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("user_id", "event_id", k.alias("k"))
    rows = rows.withColumn("pos", F.when(F.col("event_id") % 4 != 0, F.col("k") + (F.col("event_id") % 11 == 0).cast("int")))
    return ordered.gaps_filled(rows, ["user_id"], ["event_id"], "pos", "filled").select("event_id", F.col("filled").cast("bigint").alias("filled"))


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 7 = 0 THEN 30 ELSE 0 END AS pos FROM events),
w AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY event_id) AS p, lead(pos) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM n)
SELECT event_id, CAST(CASE WHEN p + 1 = q - 1 AND pos <> p + 1 THEN p + 1 ELSE pos END AS BIGINT) AS fixed FROM w""")
def q_lag_repair(t):
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("user_id", "event_id", (k + F.when(F.col("event_id") % 7 == 0, 30).otherwise(0)).alias("pos"))
    return rows.select("event_id", ordered.neighbours_agree(F.col("pos"), ["user_id"], ["event_id"]).cast("bigint").alias("fixed"))


@query("""
WITH s AS (SELECT user_id, event_id, event_type, CAST(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS section FROM events)
SELECT user_id, section, count(*) AS n, min(event_id) AS first FROM s GROUP BY 1, 2""")
def q_sections(t):
    """Header rows begin a section."""
    rows = t.events.select("user_id", "event_id", ordered.segment(F.col("event_type") == "signup", ["user_id"], ["event_id"], closes=False).alias("section"))
    return rows.groupBy("user_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""
SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS continues FROM events WHERE event_type = 'purchase'""")
def q_continuation(t):
    """The main table before, among main tables."""
    return t.events.where("event_type = 'purchase'").select("event_id", F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id")).alias("continues"))


@query("""
WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM events)
SELECT event_id, coalesce(abs(value - t) < 1, FALSE) AS reprinted FROM m""")
def q_reprinted_total(t):
    """A row that repeats the last total before it."""
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(ordered.before(["user_id"], ["event_id"]))
    return t.events.select("event_id", "value", last.alias("t")).select("event_id", F.coalesce(F.abs(F.col("value") - F.col("t")) < 1, F.lit(False)).alias("reprinted"))


@query("""
WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 3600 + event_id % 7200 AS e FROM events),
f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
i AS (SELECT *, sum((far IS NULL OR s > far)::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, k""")
def q_coalesce_intervals(t):
    rows = t.events.select("user_id", F.unix_timestamp("ts").alias("s"), (F.unix_timestamp("ts") + 3600 + F.col("event_id") % 7200).alias("e"))
    return ordered.islands(rows, ["user_id"], "s", "e")


@query("""
WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 5 AS new FROM events),
c AS (SELECT user_id, value, CAST(sum(coalesce(new, FALSE)::INT) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM d)
SELECT user_id, cluster, round(avg(value) * 10000.0) / 10000.0 AS center, count(*) AS n FROM c GROUP BY 1, 2""")
def q_cluster_1d(t):
    got = ordered.clusters(t.events.select("user_id", "value"), ["user_id"], "value", 5.0)
    return got.select("user_id", "cluster", scaled(F.col("center"), 4).alias("center"), "n")


@query("""
WITH l AS (SELECT user_id, list_transform(list_sort(list(value)), lambda x: [x]) AS v FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_transform(list_reduce(v, lambda a, b: CASE WHEN b[1] >= a[len(a)] + 3 THEN list_concat(a, b) ELSE a END), lambda x: CAST(round(x * 100) AS BIGINT)), ',') AS kept FROM l""")
def q_greedy_dedup(t):
    """Values that are at least 3 above the last one kept. The array of one user is bounded by the user's events."""
    got = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    kept = F.transform(ordered.far_from_last_kept(F.col("v"), 3.0), lambda x: F.round(x * 100).cast("bigint"))
    return got.select("user_id", F.array_join(kept, ",").alias("kept"))


@query("""
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, array_to_string(list(k ORDER BY k), ',') AS marked FROM n WHERE role = 'assistant' GROUP BY 1""")
def q_row_numbers(t):
    """Numbers of the rows that need attention, counted before they are picked out."""
    rows = t.conversations.select("conv_id", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("k"))
    return rows.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("marked"))


@query("""
WITH m AS (SELECT date_trunc('minute', ts) - to_minutes(k) AS start, event_type FROM events, range(5) r(k))
SELECT start, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS flagged, count(*) FILTER (WHERE event_type = 'error') / count(*) AS share FROM m GROUP BY 1""")
def q_rate_window(t):
    """Share of errors in windows of five minutes, a window each minute."""
    return rates.share(t.events, F.col("event_type") == "error").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, round(quantile_cont(value, 0.95) * 1000000.0) / 1000000.0 AS q, count(*) AS n FROM events GROUP BY 1, 2""")
def q_p95_window(t):
    got = rates.quantile(t.events, ["event_type"], "value", 0.95, "6 hours", accuracy=None)  # as the SQL is
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), scaled(F.col("q"), 6).alias("q"), "n")


@query("""
WITH c AS (SELECT user_id, ts, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS changed FROM events)
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) FILTER (WHERE changed) AS BIGINT) AS changes FROM c GROUP BY 1, 2""")
def q_changes(t):
    return rates.changes(t.events, "user_id", "event_type", "event_id", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT user_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS age FROM events GROUP BY 1 HAVING age > 43200""")
def q_staleness(t):
    """Users not seen for half a day."""
    return rates.staleness(t.events, "user_id", F.lit("2024-01-31 00:00:00").cast("timestamp")).where("age > 43200").select("user_id", "age")
