"""Aggregation, top-k and set-operation queries (AG1-AG30, TK1-TK6, SO1-SO3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import timefn as tf
from ..operators import aggregates as ag
from ..operators import attribution as attr
from ..sources.tables import Tables
from .q_scalar import COEF_SQL, coef_table
from .registry import money_sum, r6, register
from .views import ACTS_SQL, POSTS_SQL, acts, posts

WEEK_SQL = "CAST(CAST({c} AS DATE) - CAST(dayofweek({c}) AS INTEGER) AS TIMESTAMP)"


def week(c):
    return tf.as_week(c).cast("timestamp")


@register("ag1_collapse_zaps", f"""
WITH {ACTS_SQL},
a AS (SELECT * FROM acts WHERE invoiceActionState IS DISTINCT FROM 'FAILED'),
g AS (SELECT itemId, userId, created_at, COUNT(*) FILTER (WHERE act = 'TIP') AS ntip,
             COALESCE(SUM(msats / 1000) FILTER (WHERE act = 'TIP'), 0) AS tip,
             COALESCE(SUM(msats / 1000) FILTER (WHERE act = 'FEE'), 0) AS fee
      FROM a GROUP BY 1, 2, 3)
SELECT itemId, userId, created_at AS zap_time, ROUND(tip, 6) AS tip_sats, ROUND(fee, 6) AS fee_sats,
       ROUND(tip + fee, 6) AS sats, ROUND(fee / NULLIF(tip + fee, 0), 6) AS sybil_rate
FROM g WHERE ntip > 0
""")
def ag1_collapse_zaps(spark, d):
    z = attr.collapse_acts(acts(Tables(spark, d)), ["itemId", "userId", "created_at"], "act",
                           F.col("msats") / 1000, state_col="invoiceActionState", time_name="zap_time")
    return z.select("itemId", "userId", "zap_time", *[r6(c).alias(c) for c in
                                                       ("tip_sats", "fee_sats", "sats", "sybil_rate")])


@register("ag2_collapse_downzaps", f"""
WITH {ACTS_SQL}
SELECT itemId, userId, created_at AS downzap_time, ROUND(COALESCE(SUM(msats / 1000), 0), 6) AS downzap_sats
FROM acts WHERE invoiceActionState IS DISTINCT FROM 'FAILED' AND act = 'DONT_LIKE_THIS' GROUP BY 1, 2, 3
""")
def ag2_collapse_downzaps(spark, d):
    z = attr.collapse_single_act(acts(Tables(spark, d)), ["itemId", "userId", "created_at"], "act",
                                 F.col("msats") / 1000, "DONT_LIKE_THIS", "downzap_sats",
                                 state_col="invoiceActionState")
    return z.select("itemId", "userId", F.col("created_at").alias("downzap_time"), r6("downzap_sats").alias("downzap_sats"))


@register("ag6_uploads_per_item", """
SELECT o.o_orderkey, COALESCE(u.n_uploads, 0) AS n_uploads FROM orders o
LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_uploads FROM lineitem WHERE l_quantity > 40 GROUP BY 1) u
  ON o.o_orderkey = u.l_orderkey
""")
def ag6_uploads(spark, d):
    t = Tables(spark, d)
    u = (t.lineitem.where(F.col("l_quantity") > 40).groupBy(F.col("l_orderkey").alias("o_orderkey"))
         .agg(F.count(F.lit(1)).alias("n_uploads")))
    return attr.attach(t.orders.select("o_orderkey"), u, "o_orderkey", {"n_uploads": 0})


@register("ag7_entity_birth", """
WITH dcl AS (SELECT user_id, min(ts) AS declared FROM events WHERE event_type = 'signup' GROUP BY 1),
act AS (SELECT user_id, min(ts) AS first_act FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT dcl.user_id, least(dcl.declared, act.first_act) AS created_at FROM dcl LEFT JOIN act USING (user_id)
""")
def ag7_entity_birth(spark, d):
    e = Tables(spark, d).events
    dcl = e.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("declared"))
    out = ag.entity_birth(dcl, e.where(F.col("event_type") != "signup"), "user_id", "declared", "ts")
    return out.select("user_id", "created_at")


def nation_transfers(t):
    """Territory = customer's nation; a signup by user u hands that nation to u."""
    e, c = t.events, t.customer
    s = (e.where(F.col("event_type") == "signup")
         .join(c.select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id"))
    w = Window.partitionBy("c_nationkey").orderBy("ts", "event_id")
    cur = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("currentOwner"))
    tr = (s.join(cur, "c_nationkey")
          .select(F.col("c_nationkey").alias("subName"), F.col("ts").alias("created_at"),
                  F.coalesce(F.lag("user_id").over(w), F.col("currentOwner")).alias("oldUserId"),
                  F.col("user_id").alias("newUserId")))
    ents = (c.join(t.orders, c.c_custkey == F.col("o_custkey")).groupBy("c_nationkey")
            .agg(F.min("o_orderdate").alias("created_at"), F.max("c_custkey").alias("currentOwner"))
            .withColumnRenamed("c_nationkey", "subName"))
    return ents, tr


NATION_TRANSFERS_SQL = """
s AS (SELECT e.*, c.c_nationkey FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup'),
cur AS (SELECT c_nationkey, max(c_custkey) AS currentOwner FROM customer GROUP BY 1),
tr AS (SELECT s.c_nationkey AS subName, s.ts AS created_at,
              COALESCE(lag(s.user_id) OVER (PARTITION BY s.c_nationkey ORDER BY s.ts, s.event_id), cur.currentOwner)
                AS oldUserId, s.user_id AS newUserId
       FROM s JOIN cur USING (c_nationkey)),
ents AS (SELECT c.c_nationkey AS subName, min(o.o_orderdate) AS created_at, max(c.c_custkey) AS currentOwner
         FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1)"""


@register("ag8_ownership_history", f"""
WITH {NATION_TRANSFERS_SQL},
f AS (SELECT subName, arg_min(oldUserId, created_at) AS first_old FROM tr GROUP BY 1)
SELECT ents.created_at AS timeStamp, ents.subName, CAST(0 AS BIGINT) AS userIdFrom,
       CAST(COALESCE(f.first_old, ents.currentOwner) AS BIGINT) AS userIdTo
FROM ents LEFT JOIN f USING (subName)
UNION ALL
SELECT created_at, subName, CAST(oldUserId AS BIGINT), CAST(newUserId AS BIGINT) FROM tr
""")
def ag8_ownership_history(spark, d):
    ents, tr = nation_transfers(Tables(spark, d))
    return ag.ownership_history(ents, tr)


@register("ag10_daily_min_cost", f"""
WITH {POSTS_SQL}
SELECT subName, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS date, ROUND(MIN(cost), 6) AS posting_fee
FROM posts WHERE invoiceActionState IS DISTINCT FROM 'FAILED' AND cost > 0 AND subName IS NOT NULL
GROUP BY 1, 2
""")
def ag10_daily_min_cost(spark, d):
    p = posts(Tables(spark, d))
    return (p.where(pr.not_failed() & (F.col("cost") > 0) & F.col("subName").isNotNull())
            .groupBy("subName", tf.as_date("created_at").cast("timestamp").alias("date"))
            .agg(r6(F.min("cost")).alias("posting_fee")))


@register("ag11_conditional_counts", """
SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_failed,
       COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, min(o_orderdate) AS first_date
FROM orders GROUP BY 1
""")
def ag11_conditional_counts(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_failed"),
                                      F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
                                      F.min("o_orderdate").alias("first_date"))


@register("ag12_first_qualifying_event", """
SELECT p.user_id, min(p.ts) AS first_paid_after_signup
FROM events p JOIN (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1) s
  ON p.user_id = s.user_id AND p.ts > s.s
WHERE p.event_type = 'purchase' AND p.value > 40
GROUP BY 1
""")
def ag12_first_qualifying(spark, d):
    e = Tables(spark, d).events
    s = e.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("s"))
    p = e.where((F.col("event_type") == "purchase") & (F.col("value") > 40))
    return (p.join(s, "user_id").where(F.col("ts") > F.col("s")).groupBy("user_id")
            .agg(F.min("ts").alias("first_paid_after_signup")))


@register("ag13_tk6_ordered_lists", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT o_custkey, min(o_orderpriority) AS main, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS "all",
       COUNT(*) AS n
FROM d GROUP BY 1
""")
def ag13_ordered_lists(spark, d):
    o = Tables(spark, d).orders
    return ag.ordered_list(o, "o_custkey", "o_orderpriority", "o_orderpriority")


@register("ag14_bool_or", """
SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ever_failed FROM orders GROUP BY 1
""")
def ag14_bool_or(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ever_failed"))


@register("ag15_weekly_totals", f"""
SELECT l_suppkey, {WEEK_SQL.format(c='l_shipdate')} AS week, ROUND(SUM(l_quantity), 6) AS quantity,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price,
       ROUND(SUM(l_discount), 6) AS discount, ROUND(SUM(l_tax), 6) AS tax
FROM lineitem GROUP BY 1, 2
""")
def ag15_weekly_totals(spark, d):
    li = Tables(spark, d).lineitem
    return li.groupBy("l_suppkey", week("l_shipdate").alias("week")).agg(
        r6(F.sum("l_quantity")).alias("quantity"), money_sum("l_extendedprice").alias("price"),
        r6(F.sum("l_discount")).alias("discount"), r6(F.sum("l_tax")).alias("tax"))


@register("ag16_week_territory_owner", f"""
SELECT o_orderpriority, {WEEK_SQL.format(c='o_orderdate')} AS week, o_orderstatus, COUNT(*) AS n_posts,
       ROUND(AVG(o_totalprice), 6) AS mean_fee
FROM orders GROUP BY 1, 2, 3
""")
def ag16_week_territory_owner(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_orderpriority", week("o_orderdate").alias("week"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_posts"), r6(F.avg("o_totalprice")).alias("mean_fee"))


@register("ag17_weekly_mean_price", f"""
SELECT {WEEK_SQL.format(c='l_shipdate')} AS week, ROUND(AVG((l_extendedprice / l_quantity)), 6) AS btc_price
FROM lineitem GROUP BY 1
""")
def ag17_weekly_mean_price(spark, d):
    li = Tables(spark, d).lineitem
    return li.groupBy(week("l_shipdate").alias("week")).agg(
        r6(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("btc_price"))


@register("ag18_weekly_counts_drop_partial", f"""
WITH w AS (SELECT {WEEK_SQL.format(c='o_orderdate')} AS week, COUNT(*) AS n_items FROM orders GROUP BY 1)
SELECT * FROM w WHERE week < (SELECT max(week) FROM w)
""")
def ag18_weekly_counts(spark, d):
    o = Tables(spark, d).orders
    w = o.groupBy(week("o_orderdate").alias("week")).agg(F.count(F.lit(1)).alias("n_items"))
    last = w.agg(F.max("week").alias("__last"))
    return w.crossJoin(F.broadcast(last)).where(F.col("week") < F.col("__last")).drop("__last")


@register("ag19_share_histogram", """
WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1),
h AS (SELECT least(CAST(ceil((epoch_us(e.ts) - epoch_us(f.t0)) / 3600000000.0) AS BIGINT), 49) AS bin, e.value
      FROM events e JOIN f USING (user_id)),
b AS (SELECT bin, SUM(value) AS s FROM h GROUP BY 1)
SELECT bin, ROUND(s / SUM(s) OVER (), 6) AS share,
       ROUND(SUM(CASE WHEN bin <= 48 THEN s END) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / SUM(s) OVER (), 6) AS cum_share
FROM b
""")
def ag19_share_histogram(spark, d):
    e = Tables(spark, d).events
    f = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    h = e.join(f, "user_id")
    out = ag.share_histogram(h, tf.ceil_hours_between("ts", "t0").cast("bigint"), F.col("value"), 49, 48)
    return out.select("bin", r6("share").alias("share"), r6("cum_share").alias("cum_share"))


@register("ag20_dataset_summary", f"""
WITH {POSTS_SQL}
SELECT COUNT(*) AS n_items, COUNT(DISTINCT userId) AS n_users, COUNT(DISTINCT subName) AS n_territories,
       ROUND(SUM(cost), 6) AS total_cost, COUNT(*) FILTER (WHERE invoiceActionState IS DISTINCT FROM 'FAILED') AS n_kept
FROM posts
""")
def ag20_dataset_summary(spark, d):
    p = posts(Tables(spark, d))
    return p.agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("userId").alias("n_users"),
                 F.countDistinct("subName").alias("n_territories"), r6(F.sum("cost")).alias("total_cost"),
                 F.count_if(pr.not_failed()).alias("n_kept"))


@register("ag22_hour_of_week_profile", """
WITH x AS (SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt, value FROM events
           WHERE ts >= TIMESTAMP '2024-01-03')
SELECT CAST(((dayofweek(lt) + 6) % 7) * 24 + hour(lt) AS INTEGER) AS how, COUNT(*) AS n,
       ROUND(SUM(value), 6) AS total
FROM x GROUP BY 1
""")
def ag22_hour_of_week(spark, d):
    e = Tables(spark, d).events.where(F.col("ts") >= F.lit("2024-01-03").cast("timestamp"))
    return e.groupBy(tf.hour_of_week("ts", "America/New_York").cast("int").alias("how")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@register("ag23_group_stats_pivot", """
WITH g AS (SELECT l_returnflag, l_linestatus, AVG(l_discount) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, ROUND(MAX(m) FILTER (WHERE l_linestatus = 'F'), 6) AS "F",
       ROUND(MAX(m) FILTER (WHERE l_linestatus = 'O'), 6) AS "O"
FROM g GROUP BY 1
""")
def ag23_group_stats_pivot(spark, d):
    li = Tables(spark, d).lineitem
    s = ag.group_stats(li, ["l_returnflag", "l_linestatus"], "l_discount")
    p = s.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("mean"))
    return p.select("l_returnflag", r6("F").alias("F"), r6("O").alias("O"))


@register("ag23_group_stats", """
SELECT l_returnflag, l_linestatus, ROUND(AVG(l_discount), 6) AS mean, COUNT(l_discount) AS n,
       ROUND(STDDEV_SAMP(l_discount), 6) AS std, ROUND(STDDEV_SAMP(l_discount) / sqrt(COUNT(l_discount)), 6) AS se
FROM lineitem GROUP BY 1, 2
""")
def ag23_group_stats(spark, d):
    s = ag.group_stats(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus"], "l_discount")
    return s.select("l_returnflag", "l_linestatus", r6("mean").alias("mean"), "n", r6("std").alias("std"),
                    r6("se").alias("se"))


@register("ag24_category_summary", """
SELECT lang, COUNT(*) AS n, ROUND(AVG(n_chars), 6) AS mean_chars FROM documents GROUP BY 1
""")
def ag24_category_summary(spark, d):
    doc = Tables(spark, d).documents
    return doc.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars"))


@register("ag25_three_way_table", """
SELECT p_size > 25 AS big, p_retailprice > 1500 AS pricey, p_type, COUNT(*) AS n,
       ROUND(AVG(p_retailprice), 6) AS mean_price
FROM part GROUP BY 1, 2, 3
""")
def ag25_three_way(spark, d):
    p = Tables(spark, d).part
    return p.groupBy((F.col("p_size") > 25).alias("big"), (F.col("p_retailprice") > 1500).alias("pricey"),
                     "p_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_retailprice")).alias("mean_price"))


@register("ag26_weekly_quality_share", f"""
SELECT {WEEK_SQL.format(c='o_orderdate')} AS week,
       ROUND(COUNT(*) FILTER (WHERE o_totalprice > 200000) / COUNT(*), 6) AS hi_share
FROM orders GROUP BY 1
""")
def ag26_weekly_quality_share(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy(week("o_orderdate").alias("week")).agg(
        r6(F.count_if(F.col("o_totalprice") > 200000) / F.count(F.lit(1))).alias("hi_share"))


@register("ag28_value_counts", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def ag28_value_counts(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("ag29_node_counts_ranked", """
SELECT c_nationkey, COUNT(*) AS n, CAST(rank() OVER (ORDER BY COUNT(*) DESC) AS INTEGER) AS rnk
FROM customer GROUP BY 1
""")
def ag29_node_counts(spark, d):
    c = Tables(spark, d).customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("n"))).cast("int"))


@register("ag30_week_max_flags", f"""
SELECT user_id, {WEEK_SQL.format(c='ts')} AS week, max(CAST(value > 49 AS INTEGER)) AS any_big
FROM events GROUP BY 1, 2
""")
def ag30_week_max_flags(spark, d):
    e = Tables(spark, d).events
    return e.groupBy("user_id", week("ts").alias("week")).agg(F.max((F.col("value") > 49).cast("int")).alias("any_big"))


@register("tk2_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
""")
def tk2_top_k(spark, d):
    o = Tables(spark, d).orders
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@register("tk2_bottom_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3
""")
def tk2_bottom_k(spark, d):
    o = Tables(spark, d).orders
    return o.orderBy("o_totalprice", "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")


@register("tk3_top_groups_centred", """
WITH g AS (SELECT l_suppkey, AVG(l_discount) AS m, COUNT(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey, m - AVG(m) OVER () AS effect, n FROM g)
SELECT l_suppkey, ROUND(effect, 6) AS effect FROM c WHERE n > 30 ORDER BY effect DESC, l_suppkey LIMIT 10
""")
def tk3_top_groups(spark, d):
    li = Tables(spark, d).lineitem
    g = li.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.count(F.lit(1)).alias("n"))
    c = g.crossJoin(g.agg(F.avg("m").alias("centre"))).withColumn("effect", F.col("m") - F.col("centre"))  # one row
    return (c.where(F.col("n") > 30).orderBy(F.desc("effect"), "l_suppkey").limit(10)
            .select("l_suppkey", r6("effect").alias("effect")))


@register("tk4_most_significant", f"""
WITH {COEF_SQL}
SELECT l_suppkey, ROUND(coef, 6) AS coef FROM c WHERE abs(coef / serr) > 1.645
ORDER BY abs(coef / serr) DESC, l_suppkey LIMIT 5
""")
def tk4_most_significant(spark, d):
    c = coef_table(Tables(spark, d))
    t = F.abs(F.col("coef") / F.col("serr"))
    return c.where(t > 1.645).orderBy(t.desc(), "l_suppkey").limit(5).select("l_suppkey", r6("coef").alias("coef"))


@register("tk6_first_by_priority", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS first_order FROM orders GROUP BY 1
""")
def tk6_first_by_priority(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey"))
                                      .alias("first_order"))


@register("so1_union_missing_filled", """
SELECT d.doc_id, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic
FROM documents d JOIN labels l USING (doc_id)
UNION ALL
SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def so1_union_missing(spark, d):
    t = Tables(spark, d)
    with_l = t.documents.select("doc_id").join(t.labels, "doc_id")
    without = t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return with_l.unionByName(without, allowMissingColumns=True).fillna(0).select("doc_id", "quality", "toxic")


@register("so3_distinct_keys", "SELECT DISTINCT c_mktsegment FROM customer")
def so3_distinct(spark, d):
    return Tables(spark, d).customer.select("c_mktsegment").distinct()
