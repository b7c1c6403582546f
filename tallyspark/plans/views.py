"""Forum-schema views over the test tables, in Spark and as SQL text.

orders become posts (one per order); the territory is the customer's nation;
status 'F' is FAILED, 'O' is PAID and 'P' is NULL (so the null rules matter);
lineitem rows become item acts (N tip, A fee, R downzap).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ForumConfig

# Test-table configuration: two excluded territories, and the data end is the
# last order date (passed as a column by the queries).
TEST_CFG = ForumConfig(excluded_subs=("nation_0", "nation_1"), anon_id=7, spammer_id=11,
                       perennial_item_ids=(1, 2, 3), saloon_title="4-NOT SPECIFIED")


def posts(t):
    o, c, n = t.orders, t.customer, t.nation
    sub = (c.join(n, c.c_nationkey == n.n_nationkey)
           .select("c_custkey", F.lower("n_name").alias("subName")))
    return (o.join(sub, o.o_custkey == sub.c_custkey, "left")
            .select(F.col("o_orderkey").alias("itemId"), F.col("o_custkey").alias("userId"),
                    "subName", F.col("o_orderdate").alias("created_at"),
                    (F.col("o_totalprice") / 1000).alias("cost"),
                    F.when(F.col("o_orderstatus") == "F", "FAILED")
                    .when(F.col("o_orderstatus") == "O", "PAID").alias("invoiceActionState"),
                    (F.col("o_orderpriority") == "5-LOW").alias("bio"),
                    (F.col("o_totalprice") < 20000).alias("freebie"),
                    (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("saloon"),
                    F.col("o_orderpriority").alias("title")))


POSTS_SQL = """posts AS (
  SELECT o.o_orderkey AS itemId, o.o_custkey AS userId, lower(n.n_name) AS subName,
         o.o_orderdate AS created_at, o.o_totalprice / 1000 AS cost,
         CASE WHEN o.o_orderstatus = 'F' THEN 'FAILED' WHEN o.o_orderstatus = 'O' THEN 'PAID' END
           AS invoiceActionState,
         o.o_orderpriority = '5-LOW' AS bio, o.o_totalprice < 20000 AS freebie,
         o.o_orderpriority = '4-NOT SPECIFIED' AS saloon, o.o_orderpriority AS title
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def acts(t):
    li = t.lineitem
    return li.select(F.col("l_orderkey").alias("itemId"), F.col("l_suppkey").alias("userId"),
                     F.col("l_shipdate").alias("created_at"),
                     F.when(F.col("l_returnflag") == "N", "TIP").when(F.col("l_returnflag") == "A", "FEE")
                     .otherwise("DONT_LIKE_THIS").alias("act"),
                     (F.col("l_extendedprice") * 1000).alias("msats"),
                     F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), "FAILED")
                     .when(F.col("l_linestatus") == "O", "PAID").alias("invoiceActionState"))


ACTS_SQL = """acts AS (
  SELECT l_orderkey AS itemId, l_suppkey AS userId, l_shipdate AS created_at,
         CASE WHEN l_returnflag = 'N' THEN 'TIP' WHEN l_returnflag = 'A' THEN 'FEE' ELSE 'DONT_LIKE_THIS' END AS act,
         l_extendedprice * 1000 AS msats,
         CASE WHEN l_linestatus = 'F' AND l_tax > 0.06 THEN 'FAILED' WHEN l_linestatus = 'O' THEN 'PAID' END
           AS invoiceActionState
  FROM lineitem)"""


# ---------------------------------------------------------------------------
# Raw forum-schema tables built from the test tables (for the derived tables).
# Event times (30 days of 2024) are stretched onto the order period so that
# transfers and billing interleave with posts.
FORUM_CFG = ForumConfig(excluded_subs=("nation_0", "nation_1"), anon_id=7, spammer_id=11,
                        perennial_item_ids=(1, 2, 3), saloon_title="4-NOT SPECIFIED",
                        data_start="1995-01-01 00:00:00", data_end="2001-08-02 00:00:00",
                        sub_cost_drop_date="1998-06-01 00:00:00", sub_cost_monthly_pre=400000,
                        sub_cost_yearly_pre=800000, sub_cost_monthly_post=300000, sub_cost_yearly_post=700000,
                        perpetual_override_subs=("nation_3",), deleted_title="1-URGENT",
                        internal_link_pattern=r"https://site\.example/items/(\d+)(?:[/?#][^\s]*)?")
COMMENT_BASE = 1_000_000_000_000


def stretch(ts_col):
    return F.timestamp_micros(F.unix_micros(F.lit("1995-01-01").cast("timestamp"))
                              + (F.unix_micros(ts_col) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) * 80)


STRETCH_SQL = "make_timestamp(epoch_us(TIMESTAMP '1995-01-01') + (epoch_us({c}) - epoch_us(TIMESTAMP '2024-01-01')) * 80)"


def forum_item(t, texts: bool = True):
    """All items; without ``texts`` their texts and links are left out (an id that several texts have then gives one row)."""
    o, li, docs, pages = t.orders, t.lineitem, t.documents, t.pages
    sub = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.col("c_custkey").alias("userId"), F.col("n_name").alias("subName")))
    p = o.join(sub, o.o_custkey == sub.userId, "left")
    if texts:
        p = (p.join(docs.select(F.col("doc_id").alias("o_orderkey"), "text"), "o_orderkey", "left")
             .join(pages.select(F.col("page_id").alias("o_orderkey"), "url"), "o_orderkey", "left"))
    else:
        p = p.withColumns({"text": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    p = (p.select(F.col("o_orderkey").alias("itemId"), F.col("o_custkey").alias("userId"), "subName",
                 F.lit(None).cast("bigint").alias("parentId"), F.col("o_orderkey").alias("rootId"),
                 F.col("o_orderpriority").alias("title"), "text", "url",
                 (F.col("o_totalprice") / 1000).alias("cost"),
                 (F.col("o_orderpriority") == "5-LOW").alias("bio"),
                 (F.col("o_totalprice") < 20000).alias("freebie"),
                 F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "PAID")
                 .alias("invoiceActionState"), F.col("o_orderdate").alias("created_at")))
    c = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber") + COMMENT_BASE).alias("itemId"),
                  F.col("l_suppkey").alias("userId"), F.lit(None).cast("string").alias("subName"),
                  F.col("l_orderkey").alias("parentId"), F.col("l_orderkey").alias("rootId"),
                  F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"),
                  F.lit(None).cast("string").alias("url"), F.lit(0.0).alias("cost"), F.lit(False).alias("bio"),
                  F.lit(False).alias("freebie"),
                  F.when(F.col("l_linestatus") == "F", F.when(F.col("l_tax") > 0.06, "FAILED"))
                  .otherwise("PAID").alias("invoiceActionState"), F.col("l_shipdate").alias("created_at"))
    return p.unionByName(c)


ITEM_SQL = f"""item AS (
  SELECT o.o_orderkey AS itemId, o.o_custkey AS userId, n.n_name AS subName, CAST(NULL AS BIGINT) AS parentId,
         o.o_orderkey AS rootId, o.o_orderpriority AS title, d.text, pg.url, o.o_totalprice / 1000 AS cost,
         o.o_orderpriority = '5-LOW' AS bio, o.o_totalprice < 20000 AS freebie,
         CASE WHEN o.o_orderstatus = 'F' THEN 'FAILED' WHEN o.o_orderstatus = 'O' THEN 'PAID' END AS invoiceActionState,
         o.o_orderdate AS created_at
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey LEFT JOIN pages pg ON pg.page_id = o.o_orderkey
  UNION ALL
  SELECT l_orderkey * 100 + l_linenumber + {COMMENT_BASE}, l_suppkey, NULL, l_orderkey, l_orderkey, NULL, NULL, NULL,
         0.0, false, false,
         CASE WHEN l_linestatus = 'F' THEN (CASE WHEN l_tax > 0.06 THEN 'FAILED' END) ELSE 'PAID' END, l_shipdate
  FROM lineitem)"""


def forum_itemupload(t):
    li = t.lineitem
    return li.where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("itemId"),
                                                     (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("uploadId"))


UPLOAD_SQL = """itemupload AS (SELECT l_orderkey AS itemId, l_orderkey * 100 + l_linenumber AS uploadId
                              FROM lineitem WHERE l_quantity > 45)"""


def forum_sub(t):
    c, n = t.customer, t.nation
    o = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("__first"))  # a customer's orders are not joined one by one
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey)
    return x.groupBy(F.col("n_name").alias("name")).agg(
        F.max("c_custkey").alias("userId"),
        (F.min("__first") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(30))).alias("created_at"))


SUB_SQL = """sub AS (SELECT n.n_name AS name, max(c.c_custkey) AS userId, min(o.o_orderdate) + INTERVAL 30 DAY AS created_at
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN orders o ON c.c_custkey = o.o_custkey
  GROUP BY 1)"""


def forum_transfer(t):
    e, c, n = t.events, t.customer, t.nation
    s = (e.where(F.col("event_type") == "signup")
         .join(c.select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
         .join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"))
    cur = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("__cur"))
    w = Window.partitionBy("c_nationkey").orderBy("ts", "event_id")
    return (s.join(cur, "c_nationkey")
            .select(F.col("n_name").alias("subName"), stretch(F.col("ts")).alias("created_at"),
                    F.coalesce(F.lag("user_id").over(w), F.col("__cur")).alias("oldUserId"),
                    F.col("user_id").alias("newUserId")))


TRANSFER_SQL = f"""territorytransfer AS (
  SELECT n.n_name AS subName, {STRETCH_SQL.format(c='e.ts')} AS created_at,
         COALESCE(lag(e.user_id) OVER (PARTITION BY c.c_nationkey ORDER BY e.ts, e.event_id), cur.cur) AS oldUserId,
         e.user_id AS newUserId
  FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN (SELECT c_nationkey, max(c_custkey) AS cur FROM customer GROUP BY 1) cur ON cur.c_nationkey = c.c_nationkey
  WHERE e.event_type = 'signup')"""


def forum_subact(t):
    e, c, n = t.events, t.customer, t.nation
    return (e.where(F.col("event_type") == "purchase")
            .join(c.select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
            .join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
            .select(F.col("n_name").alias("subName"), F.col("user_id").alias("userId"),
                    F.lit("BILLING").alias("type"), (F.col("value") * 20000 * 1000).alias("msats"),
                    stretch(F.col("ts")).alias("created_at")))


SUBACT_SQL = f"""subact AS (
  SELECT n.n_name AS subName, e.user_id AS userId, 'BILLING' AS type, e.value * 20000 * 1000 AS msats,
         {STRETCH_SQL.format(c='e.ts')} AS created_at
  FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey
  WHERE e.event_type = 'purchase')"""


def forum_user_stats(t):
    o = t.orders
    p = F.col("o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("t")).agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(F.col("o_orderstatus") == "O").alias("comments"),
        (F.sum(p) * 100).alias("msats_tipped"), (F.sum(p) * 10).alias("msats_rewards"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", p * 5)).alias("msats_referrals"),
        F.sum(F.when(F.col("o_orderpriority") == "2-HIGH", p)).alias("msats_one_day_referrals"),
        (F.sum(p) * 200).alias("msats_stacked"), (F.sum(p) * 50).alias("msats_fees"),
        F.sum(F.when(F.col("o_orderstatus") == "F", p * 150)).alias("msats_spent"))


STATS_SQL = """user_stats_days AS (
  SELECT o_custkey AS id, o_orderdate AS t, COUNT(*) AS posts, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS comments,
         SUM(o_totalprice) * 100 AS msats_tipped, SUM(o_totalprice) * 10 AS msats_rewards,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 5 END) AS msats_referrals,
         SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS msats_one_day_referrals,
         SUM(o_totalprice) * 200 AS msats_stacked, SUM(o_totalprice) * 50 AS msats_fees,
         SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 150 END) AS msats_spent
  FROM orders GROUP BY 1, 2)"""


def forum_price_raw(t):
    """Daily OHLC prices derived from lineitem unit prices (the CSV's schema)."""
    li = t.lineitem
    u = F.col("l_extendedprice") / F.col("l_quantity")
    d = F.to_date("l_shipdate")
    return li.groupBy(d.alias("__d")).agg(
        F.min_by(u, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("open"),
        F.max(u).alias("high"), F.min(u).alias("low"),
        F.max_by(u, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("close")).select(
        F.col("__d").cast("timestamp").alias("timeOpen"),
        (F.col("__d").cast("timestamp") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(23),
                                                          F.lit(59), F.lit(59))).alias("timeClose"),
        "open", "high", "low", "close")
