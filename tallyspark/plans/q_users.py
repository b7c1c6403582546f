"""Users' wallets and adoption samples (DT12, DT20), dataset moments (AG21) and the model table (ES19).

Stand-ins: withdrawals and their states from orders, invoices of acts from line
items, wallets from parts (user = part size), wallet protocols from line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..estimators import linear
from ..session import stored
from ..sources.tables import Tables
from . import forum
from .q_derived import CFG, PANEL_BASE_SQL, STAFF, W_SQL, Forum, _dt15_sql, _user_panel
from .q_models import _li
from .registry import r6, register
from .views import ACTS_SQL, ITEM_SQL

#: Days from which a receiving wallet, a sending wallet, and only these, could be used, laid into the span of the test posts.
RECV_DATE, SEND_DATE, ONLY_DATE = "1994-06-01", "1995-01-01", "1996-12-31"

WALLETS_SQL = """withdrawal AS (SELECT o_custkey AS userId, o_orderdate AS created_at, o_orderpriority = '2-HIGH' AS autoWithdraw,
  CASE WHEN o_orderstatus = 'F' THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM orders),
invoice AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS confirmedAt FROM lineitem),
itemact AS (SELECT l_suppkey AS userId, l_shipdate AS created_at, CASE WHEN l_returnflag = 'N' THEN 'TIP' ELSE 'FEE' END AS act,
  CASE WHEN l_discount > 0.05 THEN l_orderkey * 10 + l_linenumber END AS invoiceId FROM lineitem),
wallet AS (SELECT p_partkey AS walletId, CAST(p_size AS BIGINT) AS userId, p_brand AS walletName, p_partkey % 7 AS priority FROM part WHERE p_partkey % 5 < 2),
walletprotocol AS (SELECT l_partkey AS walletId, l_returnflag = 'R' AS send FROM lineitem WHERE l_quantity > 45)"""
USERS_SQL = f"""{ITEM_SQL}, {WALLETS_SQL},
us AS (SELECT userId, min(created_at) AS first_item_date, COUNT(*) FILTER (WHERE parentId IS NULL) AS n_posts,
              COUNT(*) FILTER (WHERE parentId IS NOT NULL) AS n_comments
       FROM item WHERE invoiceActionState IS DISTINCT FROM 'FAILED' GROUP BY 1),
aw AS (SELECT userId, min(created_at) AS first_autowithdraw_date FROM withdrawal WHERE autoWithdraw AND status = 'CONFIRMED' GROUP BY 1),
pz AS (SELECT a.userId, min(a.created_at) AS first_p2p_zap_date FROM itemact a JOIN invoice i ON a.invoiceId = i.id
       WHERE i.confirmedAt IS NOT NULL AND a.act = 'TIP' GROUP BY 1),
cs AS (SELECT DISTINCT walletId FROM walletprotocol WHERE send),
wl AS (SELECT w.userId, arg_min(walletName, (priority, w.walletId)) AS main_wallet,
              string_agg(walletName, ',' ORDER BY priority, w.walletId) FILTER (WHERE cs.walletId IS NOT NULL) AS send_wallets,
              string_agg(walletName, ',' ORDER BY priority, w.walletId) AS wallets, count(*) AS n_wallets, count(cs.walletId) AS n_send_wallets
       FROM wallet w LEFT JOIN cs USING (walletId) GROUP BY 1)"""


def wallet_tables(t) -> dict:
    """The raw tables of withdrawals, acts, invoices and wallets."""
    o, li, p = t.orders, t.lineitem, t.part
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return {
        "withdrawal": o.select(F.col("o_custkey").alias("userId"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderpriority") == "2-HIGH").alias("autoWithdraw"),
                               F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("PENDING").alias("status")),
        "invoice": li.select(number.alias("id"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("confirmedAt")),
        "itemact": li.select(F.col("l_suppkey").alias("userId"), F.col("l_shipdate").alias("created_at"),
                             F.when(F.col("l_returnflag") == "N", "TIP").otherwise("FEE").alias("act"), F.when(F.col("l_discount") > 0.05, number).alias("invoiceId")),
        "wallet": p.where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("walletId"), F.col("p_size").cast("long").alias("userId"),
                                                      F.col("p_brand").alias("walletName"), (F.col("p_partkey") % 7).alias("priority")),
        "walletprotocol": li.where("l_quantity > 45").select(F.col("l_partkey").alias("walletId"), (F.col("l_returnflag") == "R").alias("send"))}


def users(spark, d):
    return forum.users(Forum(spark, d).item(), CFG, **wallet_tables(Tables(spark, d)))


@register("dt12_users_wallets", f"""
WITH {USERS_SQL}
SELECT us.*, aw.first_autowithdraw_date, pz.first_p2p_zap_date, COALESCE(main_wallet, '') AS main_wallet,
       COALESCE(send_wallets, '') AS send_wallets, COALESCE(wallets, '') AS wallets,
       COALESCE(n_wallets, 0) AS n_wallets, COALESCE(n_send_wallets, 0) AS n_send_wallets
FROM us LEFT JOIN aw USING (userId) LEFT JOIN pz USING (userId) LEFT JOIN wl USING (userId)
""")
def dt12_users_wallets(spark, d):
    """Users with their first confirmed auto-withdrawal, first tip paid by a confirmed invoice, and wallets by priority."""
    u = users(spark, d)
    return u.select("userId", "first_item_date", "n_posts", "n_comments", "first_autowithdraw_date", "first_p2p_zap_date", "main_wallet",
                    "send_wallets", "wallets", F.col("n_wallets").cast("bigint").alias("n_wallets"), F.col("n_send_wallets").cast("bigint").alias("n_send_wallets"))


def _regime(day: str) -> str:
    return f"pnl.week >= {W_SQL.format(c=f'DATE {day!r}')}"


def _adoption_sql(first: str, own: str) -> str:
    week = W_SQL.format(c=first)
    return f"""
WITH RECURSIVE {PANEL_BASE_SQL}, {USERS_SQL.replace(ITEM_SQL + ',', '')},
x AS (SELECT pnl.userId, pnl.week, pnl.rolling_profit1, pnl.rolling_posts, {_regime(RECV_DATE)} AS can_attach_recv, {_regime(SEND_DATE)} AS can_attach_send,
             {_regime(ONLY_DATE)} AS only_own_wallets, COALESCE(pnl.week >= {W_SQL.format(c='first_autowithdraw_date')}, false) AS attached_recv_wallet,
             COALESCE(pnl.week >= {W_SQL.format(c='first_p2p_zap_date')}, false) AS attached_send_wallet, {week} AS first_week
      FROM pnl LEFT JOIN aw USING (userId) LEFT JOIN pz USING (userId))
SELECT userId, CAST(week AS TIMESTAMP) AS week, can_attach_recv, can_attach_send, only_own_wallets, attached_recv_wallet, attached_send_wallet,
       ROUND(sign(rolling_profit1) * ln(1 + abs(rolling_profit1)), 6) AS log_rolling_profit1,
       ROUND(sign(rolling_posts) * ln(1 + abs(rolling_posts)), 6) AS log_rolling_posts
FROM x WHERE userId NOT IN {STAFF} AND userId <> {CFG.anon_id} AND {own} AND COALESCE(week <= first_week, false)
"""


def _adoption(spark, d, which):
    u = forum.adoption_weeks(users(spark, d))
    p = _user_panel(spark, d, ["rolling_profit1", "rolling_posts", *[c for c in u.columns if c != "userId"]], u)
    out = forum.adoption_samples(p, RECV_DATE, SEND_DATE, ONLY_DATE, CFG)[which]
    return out.select("userId", F.col("week").cast("timestamp").alias("week"), "can_attach_recv", "can_attach_send", "only_own_wallets",
                      "attached_recv_wallet", "attached_send_wallet", r6("log_rolling_profit1").alias("log_rolling_profit1"),
                      r6("log_rolling_posts").alias("log_rolling_posts"))


@register("dt20_adoption_receiving", _adoption_sql("first_autowithdraw_date", "can_attach_recv"))
def dt20_adoption_receiving(spark, d):
    """User-weeks that could attach a receiving wallet, up to the week of the user's first auto-withdrawal."""
    return _adoption(spark, d, "receiving")


@register("dt20_adoption_sending", _adoption_sql("first_p2p_zap_date", "can_attach_send"))
def dt20_adoption_sending(spark, d):
    """User-weeks that could attach a sending wallet, up to the week of the user's first tip paid by invoice."""
    return _adoption(spark, d, "sending")


_DT15_K = _dt15_sql()
_DT15_K = _DT15_K[:_DT15_K.index("dl AS (")].rstrip().rstrip(",")


@register("ag21_mean_std_summary", _DT15_K + """
SELECT ROUND(AVG(cost), 6) AS cost_mean, ROUND(STDDEV_SAMP(cost), 4) AS cost_sd, ROUND(AVG(sats48), 6) AS sats48_mean, ROUND(STDDEV_SAMP(sats48), 4) AS sats48_sd,
       ROUND(AVG(comments48), 6) AS comments48_mean, ROUND(STDDEV_SAMP(comments48), 4) AS comments48_sd, COUNT(*) AS n FROM k
""")
def ag21_mean_std(spark, d):
    """Mean and standard deviation of cost, sats48 and comments48 over the post-quality sample."""
    fo = Forum(spark, d)
    roots = stored(fo.root_items().select("itemId", "userId", "subName", "created_at", "cost", "invoiceActionState", "bio", "freebie", "saloon",
                                          "n_roots"), "root_items")
    p = fo.measured(forum.quality_posts(roots, CFG), roots)
    q = forum.post_quality_sample(p, fo.transfers(), fo.weekly_prices(), CFG, columns=["sats48", "comments48"])
    return q.agg(*[x for c in ("cost", "sats48", "comments48") for x in (r6(F.avg(c)).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_sd"))],
                 F.count(F.lit(1)).alias("n"))


XS = ("l_discount", "l_tax", "l_quantity")


def _cells_sql(x: str) -> str:
    m = "m_" + x[2:]
    fit = (f"(SELECT regr_slope(y, {x}) AS b, regr_intercept(y, {x}) AS a, count(*) AS n, regr_sxx(y, {x}) AS sxx, sum({x} * {x}) AS sx2, "
           f"regr_syy(y, {x}) * (1 - regr_r2(y, {x})) AS ssr FROM d)")
    return (f"SELECT '(Intercept)' AS coef_name, '{m}' AS model, a AS coef, sqrt(ssr / (n - 2) * sx2 / (n * sxx)) AS se FROM {fit} "
            f"UNION ALL SELECT 'x', '{m}', b, sqrt(ssr / (n - 2) / sxx) FROM {fit}")


@register("es19_model_table", f"""
WITH d AS (SELECT ln(l_extendedprice) AS y, l_discount, l_tax, l_quantity FROM lineitem),
c AS ({' UNION ALL '.join(_cells_sql(x) for x in XS)}),
t AS (SELECT coef_name, model, CASE WHEN se = 0 OR abs(coef / se) > 2.576 THEN '***' WHEN abs(coef / se) > 1.96 THEN '**'
             WHEN abs(coef / se) > 1.645 THEN '*' ELSE '' END AS stars, coef, se FROM c)
SELECT coef_name, """ + ", ".join(f"max(CASE WHEN model = 'm_{x[2:]}' THEN printf('%.3f', coef) || stars END) AS m_{x[2:]}, "
                                  f"max(CASE WHEN model = 'm_{x[2:]}' THEN '(' || printf('%.3f', se) || ')' END) AS m_{x[2:]}_se" for x in XS) + """
FROM t GROUP BY coef_name
""")
def es19_model_table(spark, d):
    """Three models side by side: a cell with three decimals and its stars, and one with the standard error."""
    li = _li(Tables(spark, d))
    tabs = None
    for x in XS:
        t = linear.ols(li, "y", [x], name="m_" + x[2:]).table(spark)
        t = t.where(~F.col("coef_name").startswith("_")).withColumn("coef_name", F.when(F.col("coef_name") == "(Intercept)", "(Intercept)").otherwise("x"))
        tabs = t if tabs is None else tabs.unionByName(t)
    return linear.model_table(tabs, ["m_" + x[2:] for x in XS])
