"""Join and attribution queries (JN1-JN13, AG3-AG5) on the test tables.

Roles (see README): orders are posts (item = o_orderkey, user = o_custkey,
territory = o_orderpriority, cost = o_totalprice, time = o_orderdate, 'F' =
failed); lineitem rows are zaps on an order (zapper = l_suppkey, sats =
l_extendedprice, time = l_shipdate; return flag N = tip, A = fee, R = downzap);
events are user acts (signup = ownership change, purchase = billing).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefn as tf
from ..operators import attribution as attr
from ..operators import intervals, panel, scan
from ..sources.tables import Tables
from .registry import r6, register

H48 = 48 * 3600 * 1000000


def _sats48(spark, d, hours=48, lower=None, flag=None):
    t = Tables(spark, d)
    li = t.lineitem
    if flag is not None:
        li = li.where(F.col("l_returnflag") == flag)
    m = attr.windowed_attribution(li, t.orders, event_key="l_orderkey", parent_key="o_orderkey",
                                  event_time="l_shipdate", parent_time="o_orderdate", hours=hours,
                                  lower_hours=lower, sums={"sats48": "l_extendedprice"},
                                  distinct=("zappers48", "l_suppkey"))
    out = attr.attach(t.orders.select("o_orderkey"), m, "o_orderkey", {"sats48": 0.0, "zappers48": 0})
    return out.select("o_orderkey", r6("sats48").alias("sats48"), "zappers48")


SATS48_SQL = """
SELECT o.o_orderkey, ROUND(COALESCE(a.sats48, 0), 6) AS sats48, COALESCE(a.zappers48, 0) AS zappers48
FROM orders o LEFT JOIN (
  SELECT l.l_orderkey, SUM(l.l_extendedprice) AS sats48, COUNT(DISTINCT l.l_suppkey) AS zappers48
  FROM lineitem l JOIN orders p ON l.l_orderkey = p.o_orderkey
  WHERE {cond}
  GROUP BY l.l_orderkey) a ON o.o_orderkey = a.l_orderkey
"""
D = "(epoch_us(l.l_shipdate) - epoch_us(p.o_orderdate))"


@register("ag3_sats48_attribution", SATS48_SQL.format(cond=f"{D} <= {H48}"))
def ag3_sats48(spark, d):
    return _sats48(spark, d)


@register("ag3_sats_window_bounded",
          SATS48_SQL.format(cond=f"{D} <= {30 * 24 * 3600 * 1000000} AND {D} >= 0"))
def ag3_sats_bounded(spark, d):
    return _sats48(spark, d, hours=30 * 24, lower=0)


@register("ag4_downsats48", SATS48_SQL.format(cond=f"{D} <= {H48} AND l.l_returnflag = 'R'")
          .replace("sats48", "downsats48").replace("zappers48", "downzappers48"))
def ag4_downsats48(spark, d):
    return (_sats48(spark, d, flag="R").withColumnRenamed("sats48", "downsats48")
            .withColumnRenamed("zappers48", "downzappers48"))


@register("ag5_comments48", f"""
SELECT o.o_orderkey, COALESCE(a.comments48, 0) AS comments48
FROM orders o LEFT JOIN (
  SELECT l.l_orderkey, COUNT(*) AS comments48
  FROM lineitem l JOIN orders p ON l.l_orderkey = p.o_orderkey
  WHERE l.l_linestatus IS DISTINCT FROM 'F' AND {D} <= {H48}
  GROUP BY l.l_orderkey) a ON o.o_orderkey = a.l_orderkey
""")
def ag5_comments48(spark, d):
    t = Tables(spark, d)
    c = t.lineitem.where(~F.col("l_linestatus").eqNullSafe("F"))
    m = attr.windowed_attribution(c, t.orders, event_key="l_orderkey", parent_key="o_orderkey",
                                  event_time="l_shipdate", parent_time="o_orderdate",
                                  count_name="comments48")
    return attr.attach(t.orders.select("o_orderkey"), m, "o_orderkey", {"comments48": 0})


CONV_ITEMS_SQL = """
  SELECT conv_id * 100000 + turn AS itemId,
         CASE WHEN turn = 0 THEN NULL ELSE conv_id * 100000 + turn - 1 END AS parentId,
         conv_id * 100000 AS rootId, role, text
  FROM conversations"""


def conv_items(t):
    c = t.conversations
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("itemId"),
                    F.when(F.col("turn") == 0, F.lit(None).cast("bigint"))
                    .otherwise(F.col("conv_id") * 100000 + F.col("turn") - 1).alias("parentId"),
                    (F.col("conv_id") * 100000).alias("rootId"), "role", "text")


@register("jn1_root_attach", f"""
WITH items AS ({CONV_ITEMS_SQL}),
roots AS (SELECT itemId AS rootId, role AS root_role, length(text) AS root_len FROM items WHERE parentId IS NULL)
SELECT i.itemId, CAST(i.parentId AS DOUBLE) AS parentId, i.rootId, r.root_role, r.root_len FROM items i LEFT JOIN roots r ON i.rootId = r.rootId
""")
def jn1_root_attach(spark, d):
    items = conv_items(Tables(spark, d))
    roots = items.where(F.col("parentId").isNull()).select(
        F.col("itemId").alias("rootId"), F.col("role").alias("root_role"),
        F.length("text").alias("root_len"))
    return items.join(roots, "rootId", "left").select("itemId", F.col("parentId").cast("double").alias("parentId"),
                                                      "rootId", "root_role", "root_len")


@register("jn2_left_join_fill", """
SELECT c.c_custkey, COALESCE(n.n_orders, 0) AS n_orders, ROUND(COALESCE(n.spent, 0), 6) AS spent
FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders, SUM(o_totalprice) AS spent
                           FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY o_custkey) n
  ON c.c_custkey = n.o_custkey
""")
def jn2_left_join_fill(spark, d):
    t = Tables(spark, d)
    m = (t.orders.where(~F.col("o_orderstatus").eqNullSafe("F")).groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
         .withColumnRenamed("o_custkey", "c_custkey"))
    out = attr.attach(t.customer.select("c_custkey"), m, "c_custkey", {"n_orders": 0, "spent": 0.0})
    return out.select("c_custkey", "n_orders", r6("spent").alias("spent"))


@register("jn4_asof_owner", """
WITH l AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, date_trunc('second', ts) AS rts, max(event_id) AS owner_event_id,
             arg_max(value, event_id) AS owner_value
      FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, l.ts, l.value, CAST(r.owner_event_id AS DOUBLE) AS owner_event_id, r.owner_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts
""")
def jn4_asof_owner(spark, d):
    e = Tables(spark, d).events
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    right = e.where(F.col("event_type") == "signup").select(
        "user_id", "ts", F.col("event_id").alias("owner_event_id"), F.col("value").alias("owner_value"))
    out = scan.asof_join(left, right, ["user_id"], "ts", "ts", ["owner_event_id", "owner_value"],
                         truncate_seconds=True, right_order=["owner_event_id"])
    return out.withColumn("owner_event_id", F.col("owner_event_id").cast("double"))


@register("jn5_asof_two_columns", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, ts AS view_ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value
      FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, l.ts, r.view_ts, r.view_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.view_ts
""")
def jn5_asof_two_columns(spark, d):
    e = Tables(spark, d).events
    left = e.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"),
        F.col("value").alias("view_value"))
    return scan.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_ts", "view_value"],
                          right_order=["view_id"])


@register("jn7_interval_count", """
WITH s AS (SELECT user_id, ts AS spell_start,
                  COALESCE(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id),
                           (SELECT max(ts) FROM events)) AS spell_end
           FROM events WHERE event_type = 'signup')
SELECT s.user_id, s.spell_start, s.spell_end, COUNT(e.event_id) AS n_purchases
FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase'
  AND e.ts >= s.spell_start AND e.ts < s.spell_end
GROUP BY 1, 2, 3
""")
def jn7_interval_count(spark, d):
    from ..operators import sequences as sq
    e = Tables(spark, d).events
    end = e.agg(F.max("ts").alias("__end"))  # one row
    # every signup starts a spell (its id never repeats); the next start ends it (two-level scan)
    starts = sq.constant_spells(e.where(F.col("event_type") == "signup"), ["user_id"], "ts", "event_id",
                                F.lit(None).cast("timestamp"), tiebreak=["event_id"])
    spells = (starts.crossJoin(F.broadcast(end))
              .select("user_id", "spell_start", F.coalesce("spell_end", "__end").alias("spell_end")))
    pts = e.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")
    return intervals.count_in_contiguous_spells(spells, pts, ["user_id"], "spell_start", "spell_end", "ts",
                                                "n_purchases")


@register("jn8_weekly_range_aggregate", """
WITH w AS (SELECT CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS week, * FROM events),
g AS (SELECT DISTINCT week FROM w)
SELECT CAST(g.week AS TIMESTAMP) AS week, ROUND(AVG(w.value), 6) AS mean_value,
       COUNT(CASE WHEN w.event_type = 'purchase' THEN 1 END) AS n_purchase,
       COUNT(CASE WHEN w.event_type = 'error' AND w.value > 25 THEN 1 END) AS n_big_error
FROM g JOIN w ON w.ts >= CAST(g.week AS TIMESTAMP) AND w.ts < CAST(g.week AS TIMESTAMP) + INTERVAL 7 DAY
GROUP BY g.week
""")
def jn8_weekly_range_aggregate(spark, d):
    e = Tables(spark, d).events
    return intervals.calendar_bucket_aggregate(
        e, "ts", lambda c: tf.as_week(c).cast("timestamp"),
        {"mean_value": r6(F.avg("value")),
         "n_purchase": F.count(F.when(F.col("event_type") == "purchase", 1)),
         "n_big_error": F.count(F.when((F.col("event_type") == "error") & (F.col("value") > 25), 1))},
        out_name="week")


@register("jn9_panel_skeleton", """
WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id),
e AS (SELECT CAST(max(ts) AS DATE) AS last_day FROM events)
SELECT f.user_id, CAST(g.day AS TIMESTAMP) AS day
FROM f, e, LATERAL generate_series(f.first_day, e.last_day, INTERVAL 1 DAY) AS g(day)
""")
def jn9_panel_skeleton(spark, d):
    e = Tables(spark, d).events
    return panel.skeleton(e, "user_id", "ts", step="day").withColumn("day", F.col("day").cast("timestamp"))


@register("jn11_cache_anti_join", """
WITH h AS (SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT h.doc_id, h.text_hash FROM h
WHERE h.text_hash NOT IN (SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL)
""")
def jn11_cache_anti_join(spark, d):
    t = Tables(spark, d)
    batch = (t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"))
             .groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")))
    cached = t.benchmark.select(F.sha2("text", 256).alias("text_hash"))
    return batch.join(cached, "text_hash", "left_anti").select("doc_id", "text_hash")


@register("jn13_weekly_price_join", """
WITH p AS (SELECT CAST(l_shipdate AS DATE) - CAST(dayofweek(l_shipdate) AS INTEGER) AS week,
                  AVG(l_extendedprice / l_quantity) AS btc_price FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, CAST(CAST(o.o_orderdate AS DATE) - CAST(dayofweek(o.o_orderdate) AS INTEGER) AS TIMESTAMP) AS week,
       ROUND(p.btc_price, 6) AS btc_price
FROM orders o LEFT JOIN p ON p.week = CAST(o.o_orderdate AS DATE) - CAST(dayofweek(o.o_orderdate) AS INTEGER)
""")
def jn13_weekly_price_join(spark, d):
    t = Tables(spark, d)
    prices = (t.lineitem.groupBy(tf.as_week("l_shipdate").alias("week"))
              .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("btc_price")))
    o = t.orders.select("o_orderkey", tf.as_week("o_orderdate").alias("week"))
    return o.join(prices, "week", "left").select("o_orderkey", F.col("week").cast("timestamp").alias("week"),
                                                 r6("btc_price").alias("btc_price"))
