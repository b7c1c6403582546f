"""Hand-made edge fixtures (null rules, exact boundaries, text cases) and estimator checks."""

import hashlib
import re
import unicodedata
import uuid
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tallyspark.config import IMG_LINK_PATTERN
from tallyspark.estimators import kernel, linear
from tallyspark.functions import predicates as pr
from tallyspark.functions import textfn as tx
from tallyspark.functions import timefn as tf
from tallyspark.operators import attribution as attr
from tallyspark.operators import panel, quantile, scan

T0 = datetime(2024, 1, 1)


def test_not_failed_keeps_null(spark):
    df = spark.createDataFrame([(1, None), (2, "FAILED"), (3, "PAID")], "id long, s string")
    assert sorted(r.id for r in df.where(pr.not_failed("s")).collect()) == [1, 3]
    assert sorted(r.id for r in df.where(pr.not_in("s", ["PAID"])).collect()) == [1, 2]


def test_attribution_bounds(spark):
    parents = spark.createDataFrame([(1, T0)], "k long, t0 timestamp")
    h48 = timedelta(hours=48)
    ev = spark.createDataFrame([(1, T0 + h48, 1.0, 10), (1, T0 + h48 + timedelta(microseconds=1), 2.0, 11),
                                (1, T0 - timedelta(days=3), 4.0, 12), (1, T0 + timedelta(hours=1), 8.0, 10)],
                               "k long, t timestamp, s double, u long")
    r = attr.windowed_attribution(ev, parents, event_key="k", parent_key="k", event_time="t", parent_time="t0",
                                  sums={"sats48": "s"}, distinct=("zappers48", "u"), count_name="n").first()
    assert (r.sats48, r.zappers48, r.n) == (13.0, 2, 3)  # exactly 48 h and earlier events count


def test_collapse_acts_rules(spark):
    acts = spark.createDataFrame([
        (1, 1, T0, "FEE", 3.0), (2, 1, T0, "TIP", 5.0), (3, 1, T0, "TIP", 0.0), (3, 1, T0, "FEE", 0.0),
        (4, 1, T0, "TIP", 4.0), (4, 1, T0, "FEE", 1.0)], "itemId long, userId long, t timestamp, act string, a double")
    got = {r.itemId: r for r in attr.collapse_acts(acts, ["itemId", "userId", "t"], "act", "a").collect()}
    assert 1 not in got  # fee only: dropped
    assert got[2].sybil_rate == 0.0 and got[3].sybil_rate is None and got[4].sybil_rate == 0.2


def test_asof_exact_and_before_first(spark):
    right = spark.createDataFrame([("a", T0, 7)], "k string, rt timestamp, owner long")
    left = spark.createDataFrame([(1, "a", T0), (2, "a", T0 - timedelta(seconds=1)),
                                  (3, "a", T0 + timedelta(milliseconds=300))], "id long, k string, t timestamp")
    got = {r.id: r.owner for r in scan.asof_join(left, right, ["k"], "t", "rt", ["owner"],
                                                 truncate_seconds=True).collect()}
    assert got == {1: 7, 2: None, 3: 7}


def test_week_starts_sunday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 23, 59, 59),), (datetime(2024, 1, 7, 0, 0, 0),)], "t timestamp")
    w = [r.w for r in df.select(tf.as_week("t").alias("w")).collect()]
    assert [str(x) for x in w] == ["2023-12-31", "2024-01-07"]


def test_rolling_sum_full_window_rule(spark):
    rows = [(u, i, 1) for u, n in ((1, 8), (2, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "u long, i long, x long")
    got = {(r.u, r.i): r.rolling_x for r in panel.rolling_sum(df, ["u"], ["i"], ["x"], 8, 1).collect()}
    assert all(got[(1, i)] is None for i in range(8))
    assert got[(2, 8)] == 8 and got[(2, 7)] is None


def test_backfill_leading_nulls(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 0, None)],
                               "k long, i long, v double")
    got = {(r.k, r.i): r.v for r in scan.backfill(df, ["k"], ["i"], ["v"]).collect()}
    assert got == {(1, 0): 5.0, (1, 1): 5.0, (1, 2): 5.0, (1, 3): None, (2, 0): None}


TEXTS = ["", None, "   \t\n ", "![a](https://x.y/z.png)", "[t](u)", "see https://a.b/c and [x](y) z",
         "two  words here", "naïve café — Ünïcödé"]


def test_text_functions_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    out = df.select("id", "text", tx.word_count("text").alias("w"), tx.is_blank("text").alias("b"),
                    tx.count_image_or_links("text").alias("n"), tx.has_image_or_link("text").alias("h"),
                    tx.sha256_hex("text").alias("sha"), tx.uuid5_dns("text").alias("u"),
                    tx.sanitize("text").alias("san")).collect()
    pat = re.compile(IMG_LINK_PATTERN)
    for r in out:
        t = r.text or ""
        assert r.w == len(t.split())
        assert r.b == (t.strip() == "")
        assert r.n == len(pat.findall(t)) and r.h == bool(pat.search(t))
        if r.text is not None:
            assert r.sha == hashlib.sha256(t.encode()).hexdigest()
            assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, t))
            norm = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
            assert r.san == re.sub(r"[^A-Za-z0-9_]", "", norm)


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2001).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.0, 0.1, 0.5, 0.9, 0.9999, 1.0):
        assert abs(quantile.exact_quantile(df, "x", q) - np.quantile(x, q)) < 1e-12


def test_ols_and_fixed_effects_match_dense_numpy(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.integers(0, 12, n), rng.integers(0, 9, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.7 * x1 - 0.3 * x2 + rng.normal(size=12)[a] + rng.normal(size=9)[b] + rng.normal(size=n) * 0.5
    df = spark.createDataFrame([(int(a[i]), int(b[i]), float(x1[i]), float(x2[i]), float(y[i])) for i in range(n)],
                               "a long, b long, x1 double, x2 double, y double")
    # plain OLS
    X = np.column_stack([np.ones(n), x1, x2])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    fit = linear.ols(df, "y", ["x1", "x2"])
    assert np.allclose(fit.beta, beta, atol=1e-9)
    # two fixed effects with dummies, clustered by a
    D = np.column_stack([x1, x2] + [(a == k).astype(float) for k in range(12)] + [(b == k).astype(float) for k in range(1, 9)])
    full = np.linalg.lstsq(D, y, rcond=None)[0]
    fe = linear.feols(df, "y", ["x1", "x2"], ["a", "b"], cluster="a", singletons=False)
    assert np.allclose(fe.beta, full[:2], atol=1e-7)
    e = y - D @ full
    XtX_inv = np.linalg.inv(D.T @ D)
    meat = sum(np.outer(D[a == g].T @ e[a == g], D[a == g].T @ e[a == g]) for g in range(12))
    G, k = 12, D.shape[1]
    # fixest-style small-sample factor: the cluster-nested effect 'a' is not counted
    V = XtX_inv @ meat @ XtX_inv * G / (G - 1) * (n - 1) / (n - (k - 12))
    assert np.allclose(np.sqrt(np.diag(fe.vcov)), np.sqrt(np.diag(V))[:2], rtol=1e-5)


def test_kernel_regression_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.uniform(0, 10, 300), rng.normal(size=300), rng.uniform(0.5, 2, 300)
    grid = list(np.linspace(0, 10, 21))
    df = spark.createDataFrame([(float(x[i]), float(y[i]), float(w[i])) for i in range(300)], "x double, y double, w double")
    got = {r.gi: r.y_hat for r in kernel.weighted_kreg(df, "x", "y", 1.5, grid, w="w").collect()}
    K = np.exp(-0.5 * ((np.array(grid)[:, None] - x[None, :]) / 1.5) ** 2) * w[None, :]
    want = (K @ y) / K.sum(axis=1)
    assert np.allclose([got[i] for i in range(21)], want, atol=1e-10)
