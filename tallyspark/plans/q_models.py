"""Estimator queries (ES1-ES19).  Only K x K matrices and per-grid rows reach the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..estimators import kernel, linear, ml
from ..functions import textfn as tx
from ..functions import timefn as tf
from ..session import cut_lineage
from ..sources.tables import Tables
from .registry import r6, register


def _li(t):
    li = t.lineitem
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "l_quantity",
                     F.log("l_extendedprice").alias("y"), tf.as_week("l_shipdate").alias("week"))


def _round_table(df):
    return df.select("regression_name", "coef_name", r6("estimate").alias("estimate"), r6("serr").alias("serr"))


OLS_SQL = """
WITH d AS (SELECT ln(l_extendedprice) AS y, l_discount AS x FROM lineitem),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, COUNT(*) AS n, regr_sxx(y, x) AS sxx,
             SUM(x * x) AS sx2, regr_r2(y, x) AS r2 FROM d),
r AS (SELECT SUM(power(y - a - b * x, 2)) AS ssr FROM d, s)
SELECT 'ols' AS regression_name, '(Intercept)' AS coef_name, ROUND(a, 6) AS estimate,
       ROUND(sqrt(ssr / (n - 2) * sx2 / (n * sxx)), 6) AS serr FROM s, r
UNION ALL SELECT 'ols', 'l_discount', ROUND(b, 6), ROUND(sqrt(ssr / (n - 2) / sxx), 6) FROM s, r
UNION ALL SELECT 'ols', '_n', CAST(n AS DOUBLE), NULL FROM s
UNION ALL SELECT 'ols', '_r2', ROUND(r2, 6), NULL FROM s
"""


@register("es1_es5_ols", OLS_SQL)
def es1_ols(spark, d):
    fit = linear.ols(_li(Tables(spark, d)), "y", ["l_discount"], name="ols")
    return _round_table(fit.table(spark))


FE_SQL = """
WITH d AS (SELECT l_suppkey AS g, ln(l_extendedprice) AS y, l_discount AS x FROM lineitem),
m AS (SELECT y, y - AVG(y) OVER (PARTITION BY g) AS yd, x - AVG(x) OVER (PARTITION BY g) AS xd FROM d),
s AS (SELECT SUM(xd * yd) / SUM(xd * xd) AS b, SUM(xd * xd) AS sxx, COUNT(*) AS n,
             (SELECT COUNT(DISTINCT g) FROM d) AS ng FROM m),
r AS (SELECT SUM(power(yd - b * xd, 2)) AS ssr, SUM(y * y) - power(SUM(y), 2) / COUNT(*) AS tss FROM m, s)
SELECT 'feols' AS regression_name, 'l_discount' AS coef_name, ROUND(b, 6) AS estimate,
       ROUND(sqrt(ssr / (n - 1 - ng) / sxx), 6) AS serr FROM s, r
UNION ALL SELECT 'feols', '_n', CAST(n AS DOUBLE), NULL FROM s
UNION ALL SELECT 'feols', '_r2', ROUND(1 - ssr / tss, 6), NULL FROM r
"""


@register("es2_es3_feols_one_effect", FE_SQL)
def es2_feols_one(spark, d):
    fit = linear.feols(_li(Tables(spark, d)), "y", ["l_discount"], ["l_suppkey"], name="feols")
    return _round_table(fit.table(spark))


@register("es2_es4_feols_two_effects_clustered")
def es2_es4_two_fe(spark, d):
    fit = linear.feols(_li(Tables(spark, d)), "y", ["l_discount", "l_tax"], ["l_suppkey", "week"],
                       name="feols2", cluster="l_suppkey")
    return _round_table(fit.table(spark))


@register("es3_singleton_drop", """
SELECT COUNT(*) AS n_kept FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1)
""")
def es3_singletons(spark, d):
    o = Tables(spark, d).orders
    return linear.drop_singletons(o.select("o_orderkey", "o_custkey"), ["o_custkey"]).agg(
        F.count(F.lit(1)).alias("n_kept"))


@register("es12_fitted_residuals", """
WITH d AS (SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS y, l_discount AS x FROM lineitem),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d)
SELECT l_orderkey, l_linenumber, ROUND(a + b * x, 6) AS fitted, ROUND(y - a - b * x, 6) AS residual FROM d, s
""")
def es12_fitted(spark, d):
    li = _li(Tables(spark, d))
    fit = linear.ols(li, "y", ["l_discount"])
    out = linear.fitted_residuals(li, fit, "y", ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r6("fitted").alias("fitted"), r6("residual").alias("residual"))


def _doc_features(t):
    doc = t.documents
    f = doc.select("doc_id", tx.word_count("text").cast("double").alias("num_words"),
                   F.log1p("n_chars").alias("log_chars"),
                   (F.col("lang") == "en").cast("double").alias("is_en"))
    return f.join(t.labels, "doc_id")


@register("es8_logit")
def es8_logit(spark, d):
    f = _doc_features(Tables(spark, d)).withColumn("quality", F.col("quality").cast("double"))
    return _round_table(ml.logit(f, "quality", ["log_chars", "is_en"]))


@register("es13_kernel_regression", """
WITH g AS (SELECT i AS gi, i * 0.5 AS grid_x FROM range(0, 48) t(i)),
x AS (SELECT CAST(hour(ts) AS DOUBLE) + minute(ts) / 60.0 AS x, value AS y FROM events),
k AS (SELECT gi, grid_x, exp(-0.5 * power((grid_x - x) / 2.0, 2)) AS kw, y FROM g, x)
SELECT CAST(gi AS INTEGER) AS gi, grid_x, ROUND(SUM(kw * y) / SUM(kw), 6) AS y_hat FROM k GROUP BY 1, 2
""")
def es13_kernel(spark, d):
    e = Tables(spark, d).events.select((F.hour("ts").cast("double") + F.minute("ts") / 60.0).alias("x"),
                                       F.col("value").alias("y"))
    out = kernel.weighted_kreg(e, "x", "y", 2.0, [i * 0.5 for i in range(48)])
    return out.select("gi", "grid_x", r6("y_hat").alias("y_hat"))


@register("es14_kernel_bootstrap_band")
def es14_bootstrap(spark, d):
    e = Tables(spark, d).events.select("event_id", (F.hour("ts").cast("double") + F.minute("ts") / 60.0).alias("x"),
                                       F.col("value").alias("y"))
    return kernel.weighted_kreg(e, "x", "y", 2.0, [float(i) for i in range(24)], nboot=200, key="event_id")


@register("es15_moving_window_line", """
WITH g AS (SELECT i AS gi, CAST(i AS DOUBLE) AS grid_x FROM range(0, 24) t(i)),
x AS (SELECT CAST(hour(ts) AS DOUBLE) + minute(ts) / 60.0 AS x, value AS y FROM events),
m AS (SELECT gi, grid_x, AVG(y) AS window_mean FROM g JOIN x ON x.x >= grid_x - 1.5 AND x.x < grid_x + 1.5
      GROUP BY 1, 2)
SELECT ROUND(regr_slope(window_mean, grid_x), 6) AS slope, ROUND(regr_intercept(window_mean, grid_x), 6) AS intercept
FROM m
""")
def es15_moving_window(spark, d):
    e = Tables(spark, d).events.select((F.hour("ts").cast("double") + F.minute("ts") / 60.0).alias("x"),
                                       F.col("value").alias("y"))
    m = kernel.moving_window_means(e, "x", "y", 0.0, 1.0, 24, 1.5)
    return m.agg(r6(F.regr_slope("window_mean", "grid_x")).alias("slope"),
                 r6(F.regr_intercept("window_mean", "grid_x")).alias("intercept"))


@register("es16_pca_explained_variance")
def es16_pca(spark, d):
    ev, _ = ml.pca(Tables(spark, d).embeddings, "embedding", 3, key="vec_id")
    return ev


@register("es16_pca_scores")
def es16_pca_scores(spark, d):
    _, scores = ml.pca(Tables(spark, d).embeddings, "embedding", 3, key="vec_id", n_ratio=10)
    return scores


#: Principal components of title and of text vectors among the trees' features.
TITLE_PCS, TEXT_PCS = 10, 20
TREE_GROUPS = {"num_words": "num_words", "num_img_or_links": "num_img_or_links", "is_en": "is_en",
               **{f"title_emb_{k}": "title_embeddings" for k in range(TITLE_PCS)}, **{f"text_emb_{k}": "text_embeddings" for k in range(TEXT_PCS)}}


def tree_features(t):
    """One row a labelled document: word and link counts, language, and PCA scores of its title and text vectors (the halves
    of its embedding)."""
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.slice("embedding", 1, 32).cast("array<double>").alias("title"),
                            F.slice("embedding", 33, 32).cast("array<double>").alias("text_v"))
    doc = t.documents.select("doc_id", tx.word_count("text").cast("double").alias("num_words"),
                             tx.count_image_or_links("text").cast("double").alias("num_img_or_links"), (F.col("lang") == "en").cast("double").alias("is_en"))
    f = cut_lineage(doc.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id").join(v, "doc_id").dropna())
    out = f.drop("title", "text_v")
    for column, name, k in (("title", "title_emb", TITLE_PCS), ("text_v", "text_emb", TEXT_PCS)):
        _, scores = ml.pca(f, column, k, key="doc_id", n_ratio=k)
        out = out.join(scores.withColumnsRenamed({f"pc{i + 1}": f"{name}_{i}" for i in range(k)}), "doc_id")
    return cut_lineage(out)


@register("es17_es18_boosted_trees_vs_linear")
def es17_gbt(spark, d):
    return ml.boosted_trees(tree_features(Tables(spark, d)), "quality", list(TREE_GROUPS))
