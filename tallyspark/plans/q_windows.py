"""Window and ordered-scan queries (WN1-WN23).

Where the study runs a row loop, the oracle SQL is the loop itself as a
recursive CTE (WN2, WN6, WN7), so the window rewrite is checked against the
sequential definition, not against a copy of itself.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timefn as tf
from ..operators import panel, scan
from ..operators import sequences as sq
from ..sources.tables import Tables
from .registry import r6, register

DAY_SQL = "CAST(CAST({c} AS DATE) AS TIMESTAMP)"
WEEK_SQL = "CAST(CAST({c} AS DATE) - CAST(dayofweek({c}) AS INTEGER) AS TIMESTAMP)"


@register("wn1_burst_counter", """
WITH live AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'),
l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM live),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM l),
r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, sess ORDER BY ts, event_id) - 1 AS cm FROM s)
SELECT e.event_id, CAST(CASE WHEN e.event_type = 'error' THEN 0 WHEN e.user_id = 7 THEN 1 ELSE r.cm END AS INTEGER)
  AS cost_modifier
FROM events e LEFT JOIN r USING (event_id)
""")
def wn1_burst_counter(spark, d):
    e = Tables(spark, d).events.withColumn("is_bio", F.col("event_type") == "error")
    out = sq.burst_counter(e, "user_id", "ts", "event_id", 6 * 3600 * 1000000, skip="is_bio", always_one=(7,))
    return out.select("event_id", F.col("cost_modifier").cast("int").alias("cost_modifier"))


FEE_SQL = f"""f AS (SELECT o_orderpriority AS sub, {DAY_SQL.format(c='o_orderdate')} AS date,
                  MIN(o_totalprice) AS fee FROM orders GROUP BY 1, 2)"""


def daily_fee(t):
    o = t.orders
    return o.groupBy(F.col("o_orderpriority").alias("sub"), tf.as_date("o_orderdate").cast("timestamp").alias("date")
                     ).agg(F.min("o_totalprice").alias("fee"))


@register("wn2_smooth_local_extrema", f"""
WITH RECURSIVE {FEE_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY date) AS rn,
             lead(fee) OVER (PARTITION BY sub ORDER BY date) AS nf FROM f),
r(sub, rn, date, out_fee) AS (
  SELECT sub, rn, date, fee FROM n WHERE rn = 1
  UNION ALL
  SELECT n.sub, n.rn, n.date,
         CASE WHEN n.nf IS NOT NULL AND ((n.fee > r.out_fee AND n.fee > n.nf) OR (n.fee < r.out_fee AND n.fee < n.nf))
              THEN n.nf ELSE n.fee END
  FROM r JOIN n ON n.sub = r.sub AND n.rn = r.rn + 1)
SELECT sub, date, out_fee AS fee FROM r
""")
def wn2_smooth(spark, d):
    return sq.smooth_local_extrema(daily_fee(Tables(spark, d)), ["sub"], ["date"], "fee")


PANEL_SQL = f"""f AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id),
e AS (SELECT CAST(max(ts) AS DATE) AS last_day FROM events),
sk AS (SELECT f.user_id, CAST(g.day AS TIMESTAMP) AS day
       FROM f, e, LATERAL generate_series(f.first_day, e.last_day, INTERVAL 1 DAY) AS g(day)),
dly AS (SELECT user_id, {DAY_SQL.format(c='ts')} AS day,
               SUM(CASE WHEN event_type = 'purchase' THEN value END) AS purchase_value,
               COUNT(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS n_active
        FROM events GROUP BY 1, 2),
pnl AS (SELECT sk.user_id, sk.day, dly.purchase_value, COALESCE(dly.n_active, 0) AS n_active,
               COALESCE(dly.n_active, 0) > 0 AS activity
        FROM sk LEFT JOIN dly ON sk.user_id = dly.user_id AND sk.day = dly.day)"""


def user_day_panel(t):
    e = t.events
    sk = panel.skeleton(e, "user_id", "ts", step="day").withColumn("day", F.col("day").cast("timestamp"))
    dly = e.groupBy("user_id", tf.as_date("ts").cast("timestamp").alias("day")).agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("purchase_value"),
        F.count_if(F.col("event_type").isin("purchase", "click")).alias("n_active"))
    p = sk.join(dly, ["user_id", "day"], "left").fillna({"n_active": 0})
    return p.withColumn("activity", F.col("n_active") > 0)


@register("wn3_backfill_leading_nulls", f"""
WITH {PANEL_SQL}
SELECT user_id, day, ROUND(first_value(purchase_value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS purchase_value
FROM pnl
""")
def wn3_backfill(spark, d):
    p = user_day_panel(Tables(spark, d)).select("user_id", "day", "purchase_value")
    out = scan.backfill(p, ["user_id"], ["day"], ["purchase_value"])
    return out.select("user_id", "day", r6("purchase_value").alias("purchase_value"))


@register("wn4_rolling_sum_lagged", f"""
WITH {PANEL_SQL}
SELECT user_id, day,
  CASE WHEN COUNT(n_active) OVER w = 8 THEN SUM(n_active) OVER w END AS rolling_n_active
FROM pnl WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
""")
def wn4_rolling_sum(spark, d):
    p = user_day_panel(Tables(spark, d))
    out = panel.rolling_sum(p, ["user_id"], ["day"], ["n_active"], window=8, lag=1)
    return out.select("user_id", "day", "rolling_n_active")


@register("wn5_keep_groups_with_total", f"""
WITH {PANEL_SQL}
SELECT user_id, day FROM (SELECT *, SUM(COALESCE(purchase_value, 0)) OVER (PARTITION BY user_id) AS tot FROM pnl)
WHERE tot > 500
""")
def wn5_keep_groups(spark, d):
    p = user_day_panel(Tables(spark, d)).fillna({"purchase_value": 0.0})
    return panel.keep_groups_with_total(p, ["user_id"], "purchase_value", 500).select("user_id", "day")


@register("wn6_wn7_activity_spells", f"""
WITH RECURSIVE {PANEL_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn,
             COUNT(*) OVER (PARTITION BY user_id) AS cnt FROM pnl),
a(user_id, rn, w) AS (
  SELECT user_id, rn, 0 FROM n WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.rn, CASE WHEN n.activity THEN 0 ELSE a.w + 1 END FROM a JOIN n ON n.user_id = a.user_id AND n.rn = a.rn + 1),
nw AS (SELECT n.*, a.w FROM n JOIN a USING (user_id, rn)),
b(user_id, rn, l) AS (
  SELECT user_id, rn, w FROM nw WHERE rn = cnt
  UNION ALL
  SELECT nw.user_id, nw.rn, CASE WHEN nw.activity THEN 0 WHEN b.l = 0 THEN nw.w ELSE b.l END
  FROM b JOIN nw ON nw.user_id = b.user_id AND nw.rn = b.rn - 1)
SELECT nw.user_id, nw.day, CAST(nw.rn AS INTEGER) AS account_age, CAST(nw.w AS INTEGER) AS weeks_since_last_activity,
       CAST(b.l AS INTEGER) AS length_of_inactivity
FROM nw JOIN b USING (user_id, rn)
""")
def wn6_wn7_spells(spark, d):
    p = user_day_panel(Tables(spark, d))
    out = sq.activity_spells(p, "user_id", "day", "activity")
    return out.select("user_id", "day", F.col("account_age").cast("int").alias("account_age"),
                      F.col("weeks_since_last_activity").cast("int").alias("weeks_since_last_activity"),
                      F.col("length_of_inactivity").cast("int").alias("length_of_inactivity"))


@register("wn8_price_growth", f"""
WITH p AS (SELECT {WEEK_SQL.format(c='l_shipdate')} AS week, AVG(l_extendedprice / l_quantity) AS price
           FROM lineitem GROUP BY 1)
SELECT week, ROUND(ln(price) - ln(lag(price, 1) OVER w), 6) AS growth_1,
       ROUND(ln(price) - ln(lag(price, 4) OVER w), 6) AS growth_4,
       ROUND(ln(price) - ln(lag(price, 8) OVER w), 6) AS growth_8,
       ROUND(ln(price) - ln(lag(price, 52) OVER w), 6) AS growth_52
FROM p WINDOW w AS (ORDER BY week)
""")
def wn8_growth(spark, d):
    li = Tables(spark, d).lineitem
    p = li.groupBy(tf.as_week("l_shipdate").cast("timestamp").alias("week")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    g = sq.growth(p, "week", "price")
    return g.select("week", *[r6(f"growth_{k}").alias(f"growth_{k}") for k in (1, 4, 8, 52)])


WEEKLY_SQL = f"""wk AS (SELECT o_orderpriority AS sub, {WEEK_SQL.format(c='o_orderdate')} AS week,
                    ln(COUNT(*)) AS log_posts FROM orders GROUP BY 1, 2)"""


def weekly_posts(t):
    o = t.orders
    return o.groupBy(F.col("o_orderpriority").alias("sub"), tf.as_week("o_orderdate").cast("timestamp").alias("week")
                     ).agg(F.log(F.count(F.lit(1))).alias("log_posts"))


@register("wn9_first_difference", f"""
WITH {WEEKLY_SQL}
SELECT sub, week, ROUND(d, 6) AS diff, COALESCE(d > 0, false) AS diff_up, COALESCE(d < 0, false) AS diff_down
FROM (SELECT *, log_posts - lag(log_posts) OVER (PARTITION BY sub ORDER BY week) AS d FROM wk)
""")
def wn9_first_difference(spark, d):
    out = sq.first_difference(weekly_posts(Tables(spark, d)), ["sub"], ["week"], "log_posts")
    return out.select("sub", "week", r6("diff").alias("diff"), "diff_up", "diff_down")


K = 12


@register("wn10_wn11_leads_lags", f"WITH {WEEKLY_SQL} SELECT sub, week, " + ", ".join(
    [f"ROUND(lag(log_posts, {i}) OVER w, 6) AS lp_lag{i}" for i in range(1, K + 1)]
    + [f"ROUND(lead(log_posts, {i}) OVER w, 6) AS lp_lead{i}" for i in range(1, K + 1)])
    + " FROM wk WINDOW w AS (PARTITION BY sub ORDER BY week)")
def wn10_leads_lags(spark, d):
    out = sq.leads_lags(weekly_posts(Tables(spark, d)), ["sub"], ["week"], "log_posts", K, prefix="lp")
    cols = [f"lp_lag{i}" for i in range(1, K + 1)] + [f"lp_lead{i}" for i in range(1, K + 1)]
    return out.select("sub", "week", *[r6(c).alias(c) for c in cols])


@register("wn12_count_value_changes", """
SELECT o_custkey, CAST(SUM(CASE WHEN ch THEN 1 ELSE 0 END) AS BIGINT) AS n_changes
FROM (SELECT o_custkey, COALESCE(o_orderpriority <> lag(o_orderpriority) OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate, o_orderkey), false) AS ch FROM orders)
GROUP BY 1
""")
def wn12_count_changes(spark, d):
    o = Tables(spark, d).orders
    return sq.count_changes(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")


@register("wn13_jn7_constant_spells", """
WITH x AS (SELECT user_id, ts, event_id, event_type,
             COALESCE(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS ch
           FROM events),
s AS (SELECT user_id, ts AS spell_start, event_type AS spell_value,
             COALESCE(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), (SELECT max(ts) FROM events))
               AS spell_end
      FROM x WHERE ch)
SELECT s.user_id, s.spell_start, s.spell_value, s.spell_end,
       ROUND((epoch_us(s.spell_end) - epoch_us(s.spell_start)) / 86400000000.0, 6) AS days,
       COUNT(e.event_id) AS n_events
FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts >= s.spell_start AND e.ts < s.spell_end
GROUP BY 1, 2, 3, 4
""")
def wn13_constant_spells(spark, d):
    from ..operators import intervals
    e = Tables(spark, d).events
    end = e.agg(F.max("ts").alias("__end"))  # one row
    s = sq.constant_spells(e, ["user_id"], "ts", "event_type", F.lit(None).cast("timestamp"), tiebreak=["event_id"])
    s = s.crossJoin(F.broadcast(end)).withColumn("spell_end", F.coalesce("spell_end", "__end")).drop("__end")
    cnt = intervals.count_in_contiguous_spells(s, e.select("user_id", "ts", "event_id"), ["user_id"],
                                               "spell_start", "spell_end", "ts", "n_events")
    return cnt.select("user_id", "spell_start", "spell_value", "spell_end",
                      r6(tf.micros_between("spell_end", "spell_start") / 86400000000.0).alias("days"), "n_events")


@register("wn14_cumulative_adoption", f"""
WITH f AS (SELECT user_id, {DAY_SQL.format(c='min(ts)')} AS period FROM events WHERE event_type = 'purchase' GROUP BY 1),
g AS (SELECT period, COUNT(*) AS n FROM f GROUP BY 1)
SELECT period, n, CAST(SUM(n) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM g
""")
def wn14_cumulative(spark, d):
    e = Tables(spark, d).events
    f = e.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.min("ts").alias("first"))
    return sq.cumulative_count(f, tf.as_date("first").cast("timestamp"))


@register("wn15_sequence_number", """
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER)
         AS experience_posts,
       ROUND((epoch_us(o_orderdate) - epoch_us(min(o_orderdate) OVER (PARTITION BY o_custkey))) / 86400000000.0, 6)
         AS experience_days
FROM orders
""")
def wn15_sequence_number(spark, d):
    o = Tables(spark, d).orders
    out = sq.sequence_number(o, "o_custkey", "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", F.col("experience_posts").cast("int").alias("experience_posts"),
                      r6("experience_days").alias("experience_days"))


@register("wn16_strictly_prior_totals", """
WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice > 200000 AS hi FROM orders),
z AS (SELECT p.o_custkey AS poster, l.l_shipdate AS zt, l.l_extendedprice AS sats, p.hi
      FROM lineitem l JOIN p ON l.l_orderkey = p.o_orderkey)
SELECT p.o_orderkey,
  ROUND(COALESCE((SELECT SUM(sats) FROM z WHERE z.poster = p.o_custkey AND z.zt < p.o_orderdate), 0), 6) AS prior_zaps,
  ROUND(COALESCE((SELECT SUM(sats) FROM z WHERE z.poster = p.o_custkey AND z.zt < p.o_orderdate AND z.hi), 0), 6)
    AS prior_zaps_from_hi_quality,
  CAST((SELECT COUNT(*) FROM p q WHERE q.o_custkey = p.o_custkey AND q.o_orderdate < p.o_orderdate) AS DOUBLE)
    AS prior_posts,
  CAST((SELECT COUNT(*) FROM p q WHERE q.o_custkey = p.o_custkey AND q.o_orderdate < p.o_orderdate AND q.hi) AS DOUBLE)
    AS prior_hi_quality_posts
FROM p
""")
def wn16_strictly_prior(spark, d):
    t = Tables(spark, d)
    p = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") > 200000).alias("hi"))
    li = t.lineitem
    z = (li.join(p, li.l_orderkey == p.o_orderkey)
         .select(F.col("o_custkey").alias("poster"), F.col("l_shipdate").alias("zt"),
                 F.col("l_extendedprice").alias("sats"), F.col("hi").alias("zhi")))
    out = sq.strictly_prior_totals(p, z, "o_custkey", "o_orderdate", "hi", "sats", "poster", "zt", "zhi")
    return out.select("o_orderkey", r6("prior_zaps").alias("prior_zaps"),
                      r6("prior_zaps_from_hi_quality").alias("prior_zaps_from_hi_quality"),
                      "prior_posts", "prior_hi_quality_posts")


@register("wn17_lagged_running", """
WITH c AS (
  SELECT *, ln(1 + SUM(o_totalprice) OVER w) AS l, row_number() OVER w AS i, AVG(o_totalprice) OVER w AS m FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, ROUND(lag(m) OVER w, 6) AS prior_mean_o_totalprice, ROUND(lag(l) OVER w, 6) AS log_prior_o_totalprice,
  CAST(lag(i) OVER w AS DOUBLE) AS prior_n, ROUND(ln(1 + lag(i) OVER w), 6) AS log_prior_n
FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def wn17_lagged_running(spark, d):
    o = Tables(spark, d).orders
    out = sq.lagged_running(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", r6("prior_mean_o_totalprice").alias("prior_mean_o_totalprice"),
                      r6("log_prior_o_totalprice").alias("log_prior_o_totalprice"),
                      F.col("prior_n").cast("double").alias("prior_n"), r6("log_prior_n").alias("log_prior_n"))


@register("wn18_count_per_partition", f"""
SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderpriority, {WEEK_SQL.format(c='o_orderdate')}) AS congestion
FROM orders
""")
def wn18_count_per_partition(spark, d):
    o = Tables(spark, d).orders
    o = o.select("o_orderkey", "o_orderpriority", tf.as_week("o_orderdate").alias("week"))
    n = o.groupBy("o_orderpriority", "week").agg(F.count(F.lit(1)).alias("congestion"))
    return scan.join_on(o, n, ["o_orderpriority", "week"]).select("o_orderkey", "congestion")


CATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIOR_POSTS_SQL = """pp AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS cat,
                      ln(1 + o_totalprice / 1000) AS y FROM orders)"""


def prior_posts(t):
    o = t.orders
    return o.select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("cat"),
                    F.log1p(F.col("o_totalprice") / 1000).alias("y"))


def _prior_sql(kind: str) -> str:
    ordw = "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    parts, base_cols = [], []
    for i, c in enumerate(CATS):
        is_c = f"(CASE WHEN cat = '{c}' THEN 1.0 ELSE 0.0 END)"
        if kind == "decay":
            wgt = ("exp(ln(2) / (28 * 86400.0) * (epoch_us(o_orderdate) - "
                   "epoch_us((SELECT min(o_orderdate) FROM pp))) / 1e6)")
            num, den = f"{is_c} * y * {wgt}", f"{is_c} * {wgt}"
        else:
            num, den = f"{is_c} * y", is_c
        part = "PARTITION BY o_custkey " if kind == "own" else ""
        parts.append(f"SUM({num}) OVER ({part}{ordw}) AS n{i}, SUM({den}) OVER ({part}{ordw}) AS d{i}")
        base_cols.append(f"SUM({num}) AS bn{i}, SUM({den}) AS bd{i}")
    sel = []
    for i, c in enumerate(CATS):
        if kind == "uniform":
            num = f"COALESCE(s.n{i}, 0) - COALESCE(b.bn{i}, 0)"
            den = f"COALESCE(s.d{i}, 0) - COALESCE(b.bd{i}, 0)"
        else:
            num, den = f"COALESCE(s.n{i}, 0)", f"COALESCE(s.d{i}, 0)"
        sel.append(f"ROUND(({num}) / NULLIF({den}, 0), 6) AS \"prior_mean_{c}\"")
    sql = f"WITH {PRIOR_POSTS_SQL}, s AS (SELECT o_orderkey, o_custkey, {', '.join(parts)} FROM pp)"
    if kind == "uniform":
        sql += (", fu AS (SELECT o_custkey, min(o_orderdate) AS ft FROM pp GROUP BY 1),"
                f" b AS (SELECT fu.o_custkey, {', '.join(base_cols)} FROM fu LEFT JOIN pp ON pp.o_orderdate < fu.ft"
                " GROUP BY 1)"
                f" SELECT s.o_orderkey, {', '.join(sel)} FROM s LEFT JOIN b ON s.o_custkey = b.o_custkey")
    else:
        sql += f" SELECT s.o_orderkey, {', '.join(sel)} FROM s"
    return sql


def _prior_spark(spark, d, **kw):
    p = prior_posts(Tables(spark, d))
    out = sq.prior_category_means(p, "o_custkey", "o_orderdate", "o_orderkey", "cat", "y", CATS, **kw)
    return out.select("o_orderkey", *[r6(f"prior_mean_{c}").alias(f"prior_mean_{c}") for c in CATS])


@register("wn19_prior_category_mean_uniform", _prior_sql("uniform"))
def wn19_prior_uniform(spark, d):
    return _prior_spark(spark, d)


@register("wn20_prior_category_mean_own", _prior_sql("own"))
def wn20_prior_own(spark, d):
    return _prior_spark(spark, d, own_only=True)


@register("wn21_prior_category_mean_decayed", _prior_sql("decay"))
def wn21_prior_decayed(spark, d):
    return _prior_spark(spark, d, decay_half_life_days=28.0, since_user_first=False)


@register("wn23_global_prefix_sum", """
SELECT event_id, ROUND(COALESCE(SUM(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0), 6) AS running_before
FROM events
""")
def wn23_global_prefix(spark, d):
    e = Tables(spark, d).events
    out = scan.prefix_sums(e, [], "ts", {"running_before": F.col("value")}, strict=False, tiebreak=["event_id"])
    return out.select("event_id", r6("running_before").alias("running_before"))
