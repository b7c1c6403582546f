"""Scans, projections and predicates (SRC2, PRJ1-PRJ14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import timefn as tf
from ..operators.quantile import quantile_frame
from ..sources.tables import Tables
from .q_joins import CONV_ITEMS_SQL, conv_items
from .registry import money_sum, r6, register
from .views import POSTS_SQL, TEST_CFG, posts


@register("src2_scan_pruned_filtered", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O'
""")
def src2_scan(spark, d):
    o = Tables(spark, d).orders
    return (o.where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
                    & (F.col("o_orderstatus") == "O"))
            .select("o_orderkey", "o_custkey", "o_totalprice"))


@register("prj1_rename_keep", f"""
WITH {POSTS_SQL}
SELECT itemId, userId, subName, created_at, ROUND(cost, 6) AS cost FROM posts
""")
def prj1_rename_keep(spark, d):
    p = posts(Tables(spark, d))
    return p.select("itemId", "userId", "subName", "created_at", r6("cost").alias("cost"))


@register("prj2_unit_conversion", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 1000 AS msats_price,
                  NULLIF(l_discount, 0) * 1000 AS msats_discount, NULLIF(l_tax, 0) * 1000 AS msats_tax
           FROM lineitem)
SELECT l_orderkey, l_linenumber, ROUND(COALESCE(msats_price / 1000, 0), 6) AS sats_price,
       ROUND(COALESCE(msats_discount / 1000, 0), 6) AS sats_discount,
       ROUND(COALESCE(msats_tax / 1000, 0), 6) AS sats_tax
FROM m
""")
def prj2_unit_conversion(spark, d):
    li = Tables(spark, d).lineitem
    m = li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000).alias("msats_price"),
                  (F.nullif(F.col("l_discount"), F.lit(0.0)) * 1000).alias("msats_discount"),
                  (F.nullif(F.col("l_tax"), F.lit(0.0)) * 1000).alias("msats_tax"))
    conv = [r6(F.col(c) / 1000).alias(c.replace("msats_", "sats_")) for c in m.columns if c.startswith("msats_")]
    out = m.select("l_orderkey", "l_linenumber", *conv)
    return out.fillna(0.0)


@register("prj3_null_key_cleanup", """
SELECT c_custkey, lower(COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '')) AS segment
FROM customer WHERE c_custkey IS NOT NULL
""")
def prj3_null_key_cleanup(spark, d):
    c = Tables(spark, d).customer
    return (c.where(F.col("c_custkey").isNotNull())
            .select("c_custkey", F.lower(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")))
                    .alias("segment")))


@register("prj4_root_leaf_split", f"""
WITH items AS ({CONV_ITEMS_SQL})
SELECT parentId IS NULL AS is_post, COUNT(*) AS n_items FROM items GROUP BY 1
""")
def prj4_root_leaf_split(spark, d):
    items = conv_items(Tables(spark, d))
    return items.groupBy(F.col("parentId").isNull().alias("is_post")).agg(F.count(F.lit(1)).alias("n_items"))


@register("prj5_not_failed_keeps_null", f"""
WITH {POSTS_SQL}
SELECT invoiceActionState, COUNT(*) AS n FROM posts
WHERE invoiceActionState IS DISTINCT FROM 'FAILED' GROUP BY 1
""")
def prj5_not_failed(spark, d):
    p = posts(Tables(spark, d))
    return p.where(pr.not_failed()).groupBy("invoiceActionState").agg(F.count(F.lit(1)).alias("n"))


@register("prj6_analysis_sample", f"""
WITH {POSTS_SQL}
SELECT itemId FROM posts
WHERE invoiceActionState IS DISTINCT FROM 'FAILED' AND NOT bio AND NOT freebie AND NOT saloon
  AND subName IS NOT NULL AND subName <> '' AND subName NOT IN ('nation_0', 'nation_1')
  AND epoch_us((SELECT max(created_at) FROM posts)) - epoch_us(created_at) >= 172800000000
  AND title IS DISTINCT FROM '1-URGENT'
""")
def prj6_analysis_sample(spark, d):
    p = posts(Tables(spark, d))
    end = p.agg(F.max("created_at").alias("__end"))
    cond = pr.analysis_sample(TEST_CFG, data_end=F.col("__end"))
    cond = cond & pr.differs("title", "1-URGENT")
    return p.crossJoin(F.broadcast(end)).where(cond).select("itemId")


@register("prj8_deny_lists", f"""
WITH {POSTS_SQL}
SELECT itemId, userId FROM posts
WHERE userId NOT IN (9, 616, 7, 11) AND itemId NOT IN (1, 2, 3)
""")
def prj8_deny_lists(spark, d):
    p = posts(Tables(spark, d))
    return (p.where(pr.not_in("userId", (9, 616) + (TEST_CFG.anon_id, TEST_CFG.spammer_id))
                    & pr.not_in("itemId", TEST_CFG.perennial_item_ids))
            .select("itemId", "userId"))


@register("prj9_exclude_ever_owners", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')
""")
def prj9_exclude_owners(spark, d):
    t = Tables(spark, d)
    owners = t.events.where(F.col("event_type") == "signup")
    return pr.exclude_keys(t.orders.select("o_orderkey", "o_custkey"), owners, "o_custkey", "user_id")


BILL_CUT = "2024-01-15 12:00:00"


@register("prj10_11_billing_periods", f"""
WITH b AS (SELECT event_id, user_id, ts, value * 20000 AS sats FROM events WHERE event_type = 'purchase'),
p AS (SELECT *, CASE WHEN ts < TIMESTAMP '{BILL_CUT}' THEN
              (CASE WHEN sats <= 100000 THEN 'MONTHLY' WHEN sats <= 500000 THEN 'YEARLY' ELSE 'PERPETUAL' END)
            WHEN ts > TIMESTAMP '{BILL_CUT}' THEN
              (CASE WHEN sats <= 50000 THEN 'MONTHLY' WHEN sats <= 250000 THEN 'YEARLY' ELSE 'PERPETUAL' END)
            END AS period FROM b)
SELECT event_id, period,
       CASE WHEN user_id IN (1, 2) THEN ts + INTERVAL 100 YEAR
            WHEN period = 'MONTHLY' THEN ts + INTERVAL 1 MONTH + INTERVAL 5 DAY
            WHEN period = 'YEARLY' THEN ts + INTERVAL 1 YEAR + INTERVAL 5 DAY
            WHEN period = 'PERPETUAL' THEN ts + INTERVAL 100 YEAR END AS billing_cycle_end
FROM p
""")
def prj10_11_billing(spark, d):
    e = Tables(spark, d).events
    b = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts",
                                                           (F.col("value") * 20000).alias("sats"))
    b = b.withColumn("period", pr.billing_period("ts", "sats", BILL_CUT, 100000, 500000, 50000, 250000))
    return b.select("event_id", "period",
                    pr.period_end("ts", "period", key="user_id", override_keys=(1, 2)).alias("billing_cycle_end"))


@register("prj12_outlier_trim", """
SELECT COUNT(*) AS n_kept, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_kept FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.9999) FROM lineitem)
""")
def prj12_outlier_trim(spark, d):
    li = Tables(spark, d).lineitem
    cut = quantile_frame(li, "l_extendedprice", 0.9999, "__cut")
    return (li.crossJoin(F.broadcast(cut)).where(F.col("l_extendedprice") <= F.col("__cut"))
            .agg(F.count(F.lit(1)).alias("n_kept"), money_sum("l_extendedprice").alias("sum_kept")))


@register("prj13_quantile_slice_sample")
def prj13_quantile_slice_sample(spark, d):
    """Top decile and bottom decile by price, three rows each by a seeded hash order."""
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    q = quantile_frame(li, "l_extendedprice", 0.9, "__hi").crossJoin(quantile_frame(li, "l_extendedprice", 0.1, "__lo"))
    x = li.crossJoin(F.broadcast(q))
    order = F.xxhash64(F.lit(42), "l_orderkey", "l_linenumber")
    hi = x.where(F.col("l_extendedprice") > F.col("__hi")).orderBy(order).limit(3).withColumn("slice", F.lit("high"))
    lo = x.where(F.col("l_extendedprice") < F.col("__lo")).orderBy(order).limit(3).withColumn("slice", F.lit("low"))
    return hi.unionByName(lo).select("slice", "l_orderkey", "l_linenumber", "l_extendedprice")


@register("prj14_regime_flags", """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS TIMESTAMP) AS week,
       CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER)
         >= DATE '1998-01-11' - CAST(dayofweek(DATE '1998-01-11') AS INTEGER) AS after_cutover
FROM orders
""")
def prj14_regime_flags(spark, d):
    o = Tables(spark, d).orders
    wk = tf.as_week("o_orderdate")
    return (o.select(wk.cast("timestamp").alias("week"),
                     (wk >= tf.as_week(F.lit("1998-01-11").cast("timestamp"))).alias("after_cutover"))
            .distinct())
