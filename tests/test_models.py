"""Model queries that SQL cannot express, against dense numpy on the smallest test tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.estimators import linear, ml
from tallyspark.plans import q_extras, q_models
from tallyspark.sources.tables import Tables, read_table

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")
Q = entry.queries()


def table(spark, name):
    return {(r["regression_name"], r["coef_name"]): r for r in Q[name](spark, SF).collect()}


def dense_feols(y, x, fes, cluster):
    """(coefficients, clustered errors, R²) with dummies; effects nested in the cluster not counted."""
    dummies = np.column_stack([np.unique(f, return_inverse=True)[1][:, None] == np.arange(i > 0, len(np.unique(f))) for i, f in enumerate(fes)]).astype(float)
    both = np.column_stack([x, y])
    left = both - dummies @ np.linalg.lstsq(dummies, both, rcond=None)[0]
    xd, yd = left[:, :-1], left[:, -1]
    beta = np.linalg.lstsq(xd, yd, rcond=None)[0]
    e, inv, groups = yd - xd @ beta, np.linalg.inv(xd.T @ xd), np.unique(cluster)
    s = np.array([(xd * e[:, None])[cluster == g].sum(0) for g in groups])
    nested = sum(len(np.unique(f)) for f in fes if f is cluster)
    k, n = x.shape[1], len(y)
    adj = len(groups) / (len(groups) - 1) * (n - 1) / (n - k - (dummies.shape[1] - nested))
    return beta, np.sqrt(np.diag(adj * inv @ (s.T @ s) @ inv)), 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))


def test_two_effects_clustered_match_dummies(spark):
    got = table(spark, "es2_es4_feols_two_effects_clustered")
    p = q_models._li(Tables(spark, SF)).toPandas()
    week = p["week"].astype(str).to_numpy()
    keep = np.ones(len(p), bool)
    while True:  # levels with one row go, as in the query
        lone = np.zeros(len(p), bool)
        for f in (p["l_suppkey"].to_numpy(), week):
            values, place, count = np.unique(f[keep], return_inverse=True, return_counts=True)
            lone[np.flatnonzero(keep)[count[place] == 1]] = True
        if not lone.any():
            break
        keep &= ~lone
    p, week = p[keep], week[keep]
    supp = p["l_suppkey"].to_numpy()
    beta, se, r2 = dense_feols(p["y"].to_numpy(), p[["l_discount", "l_tax"]].to_numpy(), [supp, week], supp)
    for i, c in enumerate(("l_discount", "l_tax")):
        assert abs(got["feols2", c]["estimate"] - beta[i]) < 2e-6 and abs(got["feols2", c]["serr"] - se[i]) < 2e-6
    assert got["feols2", "_n"]["estimate"] == len(p) and abs(got["feols2", "_r2"]["estimate"] - r2) < 2e-6


def test_logit_matches_newton(spark):
    got = table(spark, "es8_logit")
    p = q_models._doc_features(Tables(spark, SF)).toPandas()
    x, y = np.column_stack([np.ones(len(p)), p["log_chars"], p["is_en"]]), p["quality"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    se = np.sqrt(np.diag(np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)))
    for i, c in enumerate(("(Intercept)", "log_chars", "is_en")):
        assert abs(got["logit", c]["estimate"] - beta[i]) < 1e-4 * max(1, abs(beta[i])) and abs(got["logit", c]["serr"] - se[i]) < 1e-4 * max(1, se[i])


def test_principal_components_match_numpy(spark):
    v = np.array([r["embedding"] for r in read_table(spark, SF, "embeddings").orderBy("vec_id").collect()], float)
    c = v - v.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = sorted((r["component"], r["explained_variance_ratio"]) for r in Q["es16_pca_explained_variance"](spark, SF).collect())
    np.testing.assert_allclose([r for _, r in got], (values / values.sum())[:len(got)], rtol=1e-6)
    scores = np.array([[r[f"pc{i}"] for i in (1, 2, 3)] for r in Q["es16_pca_scores"](spark, SF).orderBy("vec_id").collect()])
    for i in range(3):
        u = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        np.testing.assert_allclose(scores[:, i], c @ u, atol=1e-6)


def test_trees_beat_the_line_and_their_importances_add_up(spark):
    """Few trees on the query's own features: the linear model against numpy, importances by group."""
    f = q_models.tree_features(Tables(spark, SF)).persist()
    names = list(q_models.TREE_GROUPS)
    out = ml.boosted_trees(f, "quality", names, n_trees=15, depth=4, rate=0.2)
    got = {(r["model"], r["metric"]): r["value"] for r in out.collect()}
    p = f.toPandas()
    x, y = np.column_stack([np.ones(len(p)), p[names].to_numpy(float)]), p["quality"].to_numpy(float)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(got["linear", "rmse"] - np.sqrt((e ** 2).mean())) < 1e-6
    assert abs(got["linear", "r2"] - (1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))) < 1e-6
    assert got["boosted_trees", "rmse"] < got["linear", "rmse"]
    assert len(names) == 33 and abs(sum(v for (m, k), v in got.items() if k.startswith("importance_")) - 1) < 1e-9
    groups = {r["feature_group"]: r["importance"] for r in q_extras.importance_groups(out, q_models.TREE_GROUPS).collect()}
    assert set(groups) == {"num_words", "num_img_or_links", "is_en", "title_embeddings", "text_embeddings"}
    assert abs(groups["title_embeddings"] - sum(got["boosted_trees", f"importance_title_emb_{k}"] for k in range(10))) < 1e-12


def test_quantile_slices_come_from_the_tails(spark):
    x = np.array([r[0] for r in read_table(spark, SF, "lineitem").select("l_extendedprice").collect()])
    got = Q["prj13_quantile_slice_sample"](spark, SF).collect()
    assert sorted(r["slice"] for r in got) == ["high"] * 3 + ["low"] * 3
    for r in got:
        assert r["l_extendedprice"] > np.quantile(x, 0.9) if r["slice"] == "high" else r["l_extendedprice"] < np.quantile(x, 0.1)


def test_event_study_has_four_models_of_fifty_terms(spark, monkeypatch):
    """The quantity models against numpy with the terms that are kept."""
    kept = {}
    real = linear.event_study

    def spy(quality, quantity, **kw):
        kept["quantity"] = quantity.toPandas()
        return real(quality, quantity, **kw)

    monkeypatch.setattr(linear, "event_study", spy)
    got = Q["es7_event_study"](spark, SF).collect()
    terms = linear.event_terms(12)
    for model in ("r1", "r2", "r3", "r4"):
        mine = {r["coef_name"]: r for r in got if r["regression_name"] == model}
        assert set(terms) <= set(mine) and ("L12_growth" in mine) == (model == "r4")
        assert all((mine[t]["estimate"] is None) == mine[t]["dropped"] for t in terms)
    p = kept["quantity"].dropna(subset=[*terms, "weekId", "subId", "n_posts"])
    mine = {r["coef_name"]: r for r in got if r["regression_name"] == "r3"}
    names = [t for t in terms if not mine[t]["dropped"]]
    sub = p["subId"].to_numpy()
    beta, se, r2 = dense_feols(np.log1p(p["n_posts"].to_numpy(float)), p[names].to_numpy(float), [p["weekId"].to_numpy(), sub], sub)
    np.testing.assert_allclose([mine[t]["estimate"] for t in names], beta, atol=1e-5)
    assert mine["_n"]["estimate"] == len(p) and abs(mine["_r2"]["estimate"] - r2) < 1e-5
