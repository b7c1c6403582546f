"""Remaining inventory items: AG27, AG31, JN6, JN12 + ES6, ES7, TK1, SO2, PRJ15, PRJ16, SRC7."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..estimators import linear, ml
from ..functions import predicates as pr
from ..functions import textfn as tx
from ..functions import timefn as tf
from ..operators import scan
from ..operators import sequences as sq
from ..session import cut_lineage, stored
from ..sources import io
from ..sources.tables import Tables
from . import forum
from .q_derived import CFG, Forum, scratch
from .q_models import TREE_GROUPS, _li, tree_features
from .q_windows import PANEL_SQL, WEEKLY_SQL, user_day_panel, weekly_posts
from .registry import ORACLE, r6, register

# FIXED VALUES: embedding model limits and prices (per million input tokens, online / batch).
EMBEDDING_DIMENSION = 1536
EMBEDDING_MAX_TOKENS = 8000
EMBEDDING_INPUT_COST = 0.02
EMBEDDING_INPUT_COST_BATCH = 0.01
HASH_BYTES = 64


@register("ag31_token_cost_storage_estimate", rf"""
WITH t AS (SELECT len(regexp_extract_all(COALESCE(source, ''), '\w+|[^\w\s]', 0)) AS nt,
                  len(regexp_extract_all(COALESCE(text, ''), '\w+|[^\w\s]', 0)) AS nx FROM documents),
c AS (SELECT nt + nx AS tokens,
             greatest(1, CAST(ceil(nt / {EMBEDDING_MAX_TOKENS}.0) AS BIGINT))
             + greatest(1, CAST(ceil(nx / {EMBEDDING_MAX_TOKENS}.0) AS BIGINT)) AS requests FROM t)
SELECT CAST(SUM(requests) AS BIGINT) AS requests, CAST(SUM(tokens) AS BIGINT) AS input_tokens,
       ROUND(SUM(tokens) / 1e6 * {EMBEDDING_INPUT_COST}, 6) AS cost,
       ROUND(SUM(tokens) / 1e6 * {EMBEDDING_INPUT_COST_BATCH}, 6) AS cost_batch,
       ROUND(SUM(requests) * ({HASH_BYTES} + {EMBEDDING_DIMENSION} * 4) / 1e9, 6) AS storage_gb
FROM c
""")
def ag31_cost_estimate(spark, d):
    doc = Tables(spark, d).documents
    parts = []
    for col in ("source", "text"):
        parts.append(doc.select(F.posexplode(tx.chunk_tokens(tx.token_array(col), EMBEDDING_MAX_TOKENS))
                                .alias("i", "toks")).select(F.size("toks").alias("n")))
    ch = parts[0].unionByName(parts[1])
    agg = ch.agg(F.count(F.lit(1)).alias("requests"), F.sum("n").alias("input_tokens"))
    return agg.select(
        "requests", F.col("input_tokens").cast("bigint").alias("input_tokens"),
        r6(F.col("input_tokens") / 1e6 * EMBEDDING_INPUT_COST).alias("cost"),
        r6(F.col("input_tokens") / 1e6 * EMBEDDING_INPUT_COST_BATCH).alias("cost_batch"),
        r6(F.col("requests") * (HASH_BYTES + EMBEDDING_DIMENSION * 4) / 1e9).alias("storage_gb"))


@register("jn6_asof_daily_value", f"""
WITH {PANEL_SQL},
r AS (SELECT user_id, ts, max(event_id) AS eid, arg_max(value, event_id) AS last_purchase
      FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT p.user_id, p.day, r.last_purchase FROM pnl p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.day >= r.ts
""")
def jn6_asof_daily(spark, d):
    t = Tables(spark, d)
    p = user_day_panel(t).select("user_id", "day")
    r = t.events.where(F.col("event_type") == "purchase").select(
        "user_id", "ts", F.col("event_id").alias("eid"), F.col("value").alias("last_purchase"))
    return scan.asof_join(p, r, ["user_id"], "day", "ts", ["last_purchase"], right_order=["eid"])


@register("es6_jn12_fixed_effects_labelled", """
WITH d AS (SELECT l_suppkey AS g, ln(l_extendedprice) AS y, l_discount AS x FROM lineitem),
m AS (SELECT g, y, x, y - AVG(y) OVER (PARTITION BY g) AS yd, x - AVG(x) OVER (PARTITION BY g) AS xd FROM d),
s AS (SELECT SUM(xd * yd) / SUM(xd * xd) AS b FROM m),
e AS (SELECT g, AVG(y - b * x) AS effect, COUNT(*) AS n_obs FROM m, s GROUP BY g),
names AS (SELECT DISTINCT s_suppkey, s_name FROM supplier)
SELECT names.s_name, ROUND(e.effect, 6) AS effect, e.n_obs FROM e LEFT JOIN names ON e.g = names.s_suppkey
""")
def es6_fixed_effects(spark, d):
    t = Tables(spark, d)
    li = _li(t)
    fit = linear.feols(li, "y", ["l_discount"], ["l_suppkey"])
    eff = linear.fixed_effects(li, fit, "y", ["l_suppkey"])["l_suppkey"]
    names = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name").dropDuplicates(["l_suppkey"])
    return eff.join(names, "l_suppkey", "left").select("s_name", r6("effect").alias("effect"), "n_obs")


@register("es6_two_effects_balanced", f"""
WITH RECURSIVE {WEEKLY_SQL},
n AS (SELECT sub, count(*)::DOUBLE AS n FROM wk GROUP BY sub),
m AS (SELECT week, count(*)::DOUBLE AS n, avg(log_posts) AS y FROM wk GROUP BY week),
-- normal equations of the subs, the weeks taken out: s (x) u = b
b AS (SELECT sub, sum(log_posts - m.y) AS b FROM wk JOIN m USING (week) GROUP BY sub),
s AS (SELECT a.sub, c.sub AS other, sum(1 / m.n) AS s FROM wk a JOIN wk c USING (week) JOIN m USING (week) GROUP BY ALL),
r(sub, u, step) AS (
  SELECT sub, 0.0::DOUBLE, 0 FROM n
  UNION ALL
  SELECT r.sub, any_value(r.u) + (any_value(b.b) - any_value(n.n) * any_value(r.u) + sum(s.s * o.u)) / any_value(n.n), any_value(r.step) + 1
  FROM r JOIN n USING (sub) JOIN b USING (sub) JOIN s USING (sub) JOIN r o ON o.sub = s.other
  WHERE r.step < 400 GROUP BY r.sub),
u AS (SELECT sub, u FROM r WHERE step = 400),
w AS (SELECT week, avg(log_posts - u) AS w, count(*) AS n_obs FROM wk JOIN u USING (sub) GROUP BY week)
SELECT 'sub' AS effect_of, sub AS level, ROUND(u + (SELECT avg(w) FROM w), 6) AS effect, n.n::BIGINT AS n_obs FROM u JOIN n USING (sub)
UNION ALL
SELECT 'week', strftime(week, '%Y-%m-%d'), ROUND(w - (SELECT avg(w) FROM w), 6), n_obs FROM w
""")
def es6_two_effects(spark, d):
    """Two-way effects of a panel, balanced or not: least squares, the weeks' effects about zero (the SQL takes the weeks
    out of the normal equations and iterates on the units)."""
    w = weekly_posts(Tables(spark, d)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))
    fit = linear.Fit("means", [], np.zeros(0), np.zeros((0, 0)), 0, 0.0, 0)
    eff = linear.fixed_effects(w, fit, "log_posts", ["sub", "week"])
    out = [e.select(F.lit(f).alias("effect_of"), F.col(f).alias("level"), r6("effect").alias("effect"), "n_obs") for f, e in eff.items()]
    return out[0].unionByName(out[1])


@register("es7_event_study")
def es7_event_study(spark, d):
    """The four pre-trend models: 50 leads and lags of fee rises and falls on the quality and the quantity sample.  Terms
    that the others give have no estimate and are marked."""
    fo = Forum(spark, d)
    pnl = fo.day_panel()
    changes = cut_lineage(forum.event_study_sample(pnl, "subName", "date", "posting_fee"))
    terms = linear.event_terms(12)
    sample = forum.post_quality_sample(fo.fee_posts_with_sats(), fo.transfers(), fo.weekly_prices(), CFG, columns=["sats48"])
    quality = forum.pretrend_quality(sample, changes)
    quality = stored(quality.select("sats48", "weekId", "subId", "userId", *terms), "quality")  # mostly zeros: small by column
    quantity = cut_lineage(forum.pretrend_quantity(forum.post_quantity_sample(pnl, fo.weekly_prices()), changes)
                           .select("n_posts", "weekId", "subId", "L12_growth", *terms))
    out = None
    for fit in linear.event_study(quality, quantity):
        t = fit.table(spark).withColumn("dropped", F.col("coef_name").isin(list(fit.dropped)))
        out = t if out is None else out.unionByName(t)
    return out.select("regression_name", "coef_name", r6("estimate").alias("estimate"), r6("serr").alias("serr"),
                      r6(F.col("estimate") - 1.96 * F.col("serr")).alias("ci_low"), r6(F.col("estimate") + 1.96 * F.col("serr")).alias("ci_high"), "dropped")


@register("tk1_sorted_within_partitions", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def tk1_sorted(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return o.sortWithinPartitions("o_custkey", "o_orderdate", "o_orderkey")


@register("so2_stacked_coefficient_tables", " UNION ALL ".join(
    f"SELECT 'm_{x[2:]}' AS regression_name, '(Intercept)' AS coef_name, ROUND(regr_intercept(ln(l_extendedprice), {x}), 6)"
    f" AS estimate FROM lineitem UNION ALL SELECT 'm_{x[2:]}', '{x}', ROUND(regr_slope(ln(l_extendedprice), {x}), 6)"
    f" FROM lineitem" for x in ("l_discount", "l_tax", "l_quantity")))
def so2_stacked(spark, d):
    li = _li(Tables(spark, d))
    out = None
    for x in ("l_discount", "l_tax", "l_quantity"):
        t = linear.ols(li, "y", [x], name="m_" + x[2:]).table(spark).where(~F.col("coef_name").startswith("_"))
        out = t if out is None else out.unionByName(t)
    return out.select("regression_name", "coef_name", r6("estimate").alias("estimate"))


REGIME = "2024-01-10"


@register("prj15_at_risk_before_adoption", f"""
WITH {PANEL_SQL},
a AS (SELECT user_id, {"CAST(CAST(min(ts) AS DATE) AS TIMESTAMP)"} AS first_day FROM events
      WHERE event_type = 'purchase' AND value > 45 GROUP BY 1)
SELECT p.user_id, p.day FROM pnl p LEFT JOIN a USING (user_id)
WHERE p.day >= TIMESTAMP '{REGIME}' AND p.day <= a.first_day
""")
def prj15_at_risk(spark, d):
    t = Tables(spark, d)
    p = user_day_panel(t).select("user_id", "day")
    a = (t.events.where((F.col("event_type") == "purchase") & (F.col("value") > 45)).groupBy("user_id")
         .agg(tf.as_date(F.min("ts")).cast("timestamp").alias("first_day")))
    x = p.join(a, "user_id", "left")
    return x.where((F.col("day") >= F.lit(REGIME).cast("timestamp")) & pr.is_true(F.col("day") <= F.col("first_day"))
                   ).select("user_id", "day")


def _prj16_sql():
    inner = ORACLE["wn6_wn7_activity_spells"]
    return (f"SELECT user_id, day FROM ({inner}) x WHERE NOT (weeks_since_last_activity >= 1 AND "
            "length_of_inactivity >= 4) OR (weeks_since_last_activity = 1 AND length_of_inactivity >= 4)")


@register("prj16_at_risk_not_inactive", _prj16_sql())
def prj16_not_inactive(spark, d):
    p = sq.activity_spells(user_day_panel(Tables(spark, d)), "user_id", "day", "activity")
    inactive = (F.col("weeks_since_last_activity") >= 1) & (F.col("length_of_inactivity") >= 4)
    became = (F.col("weeks_since_last_activity") == 1) & (F.col("length_of_inactivity") >= 4)
    return p.where(~inactive | became).select("user_id", "day")


@register("src7_jsonl_results_ingest", """
SELECT COUNT(*) AS requests, COUNT(*) FILTER (label IS DISTINCT FROM 0) AS written, COUNT(*) FILTER (label = 0) AS errors,
       COUNT(*) FILTER (label IS DISTINCT FROM 0 AND vec_id < 10) AS existing,
       COUNT(*) FILTER (label IS DISTINCT FROM 0 AND vec_id >= 10) AS new
FROM embeddings
""")
def src7_ingest(spark, d):
    """Batch-result JSON lines built from the embeddings table; label 0 rows come back as errors."""
    e = Tables(spark, d).embeddings
    path = scratch(spark, "results-jsonl")
    res = e.select(F.sha2(F.col("vec_id").cast("string"), 256).alias("custom_id"),
                   F.struct(F.when(F.col("label") == 0, 500).otherwise(200).alias("status_code"),
                            F.struct(F.array(F.struct(F.col("embedding").alias("embedding"))).alias("data"))
                            .alias("body")).alias("response"),
                   F.when(F.col("label") == 0, F.lit("server error")).alias("error"))
    res.write.mode("overwrite").json(path)
    store = e.where(F.col("vec_id") < 10).select(F.sha2(F.col("vec_id").cast("string"), 256).alias("text_hash"))
    vec, errors, counts = io.ingest_results(spark, path, store)
    return spark.createDataFrame([(counts["requests"], counts["written"], counts["errors"], counts["existing"],
                                   vec.count())], "requests long, written long, errors long, existing long, new long")


def importance_groups(metrics, groups: dict[str, str]):
    """AG27: the trees' importances summed by group of features."""
    names = metrics.sparkSession.createDataFrame([("importance_" + f, g) for f, g in groups.items()], "metric string, feature_group string")
    return metrics.join(F.broadcast(names), "metric").groupBy("feature_group").agg(F.sum("value").alias("importance"))  # a row a feature


@register("ag27_feature_importance_groups")
def ag27_importance_groups(spark, d):
    return importance_groups(ml.boosted_trees(tree_features(Tables(spark, d)), "quality", list(TREE_GROUPS)), TREE_GROUPS)


@register("src4_weekly_csv_roundtrip", """
SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP) AS week_start,
       CAST(COUNT(*) AS INTEGER) AS searches
FROM events WHERE event_type = 'view' GROUP BY 1
""")
def src4_weekly_csv(spark, d):
    """A weekly series written as CSV (SRC5) and read back with its week start parsed as UTC (SRC4)."""
    from pyspark.sql import types as T
    e = Tables(spark, d).events.where(F.col("event_type") == "view")
    wk = e.groupBy(tf.as_week("ts").alias("week_start")).agg(F.count(F.lit(1)).cast("int").alias("searches"))
    path = scratch(spark, "weekly-csv")
    io.write_table(wk.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "searches"), path,
                   fmt="csv")
    schema = T.StructType([T.StructField("week_start", T.StringType()), T.StructField("searches", T.IntegerType())])
    back = io.read_delimited(spark, path, schema, sep=",", timestamp_cols=("week_start",), fmt="yyyy-MM-dd")
    return back.select("week_start", "searches")
