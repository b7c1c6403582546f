"""Fixed effects on unbalanced, disconnected and three-way panels against dense least squares."""

import random

import numpy as np
import pytest

from tallyspark.estimators import linear

NOTHING = linear.Fit("m", [], np.zeros(0), np.zeros((0, 0)), 0, 0.0, 0)


def panel(kind, seed=1):
    rng = random.Random(seed)
    if kind == "disconnected":  # two sets of firms and years that never meet, and a lone pair
        rows = [(f, y) for f in range(6) for y in range(5) if rng.random() < 0.7]
        rows += [(f, y) for f in range(6, 12) for y in range(5, 11) if rng.random() < 0.7] + [(99, 99), (99, 99)]
    else:
        rows = [(rng.randrange(14), min(rng.randrange(10), rng.randrange(10))) for _ in range(160)]
        rows += [(0, rng.randrange(10)) for _ in range(200)]  # one level holds half the rows
    return [(f, g, rng.randrange(4), 0.3 * f - 0.5 * g + rng.random(), rng.random() + 0.1 * g) for f, g in rows]


def dense(rows, columns):
    """Fitted values of the least-squares levels."""
    names = [sorted({r[c] for r in rows}) for c in columns]
    d = np.array([[float(r[c] == v) for c, vs in zip(columns, names) for v in vs] for r in rows])
    return d @ np.linalg.lstsq(d, np.array([r[3] for r in rows]), rcond=None)[0]


@pytest.mark.parametrize("kind, fes, direct", [("unbalanced", "fg", True), ("disconnected", "fg", True), ("unbalanced", "fgh", True),
                                               ("disconnected", "fg", False)])
def test_levels_are_the_least_squares_solution(spark, kind, fes, direct):
    rows, seen = panel(kind), {}
    df = spark.createDataFrame(rows, "f long, g long, h long, y double, x double")
    eff = linear.fixed_effects(df, NOTHING, "y", list(fes), direct=direct, seen=seen)
    got = {f: {r[f]: r for r in t.collect()} for f, t in eff.items()}
    fitted = [sum(got[f][r["fgh".index(f)]]["effect"] for f in fes) for r in rows]
    np.testing.assert_allclose(fitted, dense(rows, range(len(fes))), atol=1e-8)
    assert sum(r["n_obs"] for r in got["f"].values()) == len(rows)
    sets = {r["set_id"] for r in got["f"].values()}
    assert len(sets) == (3 if kind == "disconnected" else 1)
    for f in fes[1:]:  # identified: later effects about zero in each connected set
        for s in sets:
            assert abs(sum(r["effect"] for r in got[f].values() if r["set_id"] == s)) < 1e-7
    assert direct or seen["rounds"] <= 20


def test_demeaned_columns_are_residuals(spark):
    rows = panel("disconnected", 2)
    df = spark.createDataFrame(rows, "f long, g long, h long, y double, x double")
    got = linear.demean(df, ["y", "x"], ["f", "g"]).toPandas()
    for column, place in (("y", 3), ("x", 4)):
        swapped = [(*r[:3], r[place], r[4]) for r in rows]
        left = np.array([r[3] for r in swapped]) - dense(swapped, (0, 1))
        np.testing.assert_allclose(sorted(got[column]), sorted(left), atol=1e-8)


def test_three_effects_by_gradients(spark):
    rows, seen = panel("unbalanced", 3), {}
    df = spark.createDataFrame(rows, "f long, g long, h long, y double, x double")
    eff = linear.fixed_effects(df, NOTHING, "y", ["f", "g", "h"], tol=1e-8, direct=False, seen=seen)
    got = {f: {r[f]: r["effect"] for r in t.collect()} for f, t in eff.items()}
    fitted = [sum(got[f][r["fgh".index(f)]] for f in "fgh") for r in rows]
    np.testing.assert_allclose(fitted, dense(rows, range(3)), atol=1e-6)
    assert seen["rounds"] <= 20


def test_collinear_terms_are_left_out_and_named(spark):
    """Leads and lags of which some repeat others, one is a constant within its effect and one a sum: numpy with what is kept."""
    rng = np.random.default_rng(4)
    n = 400
    f, g = rng.integers(0, 8, n), rng.integers(0, 12, n)
    x = (rng.random((n, 5)) < 0.3).astype(float)
    cols = {"a": x[:, 0], "b": x[:, 1], "twin": x[:, 0], "c": x[:, 2], "sum": x[:, 0] + x[:, 1] + x[:, 2], "of_f": 2.0 * f, "d": x[:, 3], "none": np.zeros(n)}
    y = 0.5 * x[:, 0] - x[:, 1] + 0.2 * f - 0.1 * g + rng.standard_normal(n)
    names = list(cols)
    df = spark.createDataFrame([(int(f[i]), int(g[i]), float(y[i]), *[float(cols[c][i]) for c in names]) for i in range(n)], ["f", "g", "y", *names])
    fit = linear.feols(df, "y", names, ["f", "g"], cluster="f", singletons=False)
    assert fit.names == ["a", "b", "c", "d"] and fit.dropped == ("twin", "sum", "of_f", "none")
    dummies = np.column_stack([(f == i) for i in range(8)] + [(g == i) for i in range(1, 12)]).astype(float)
    design = np.column_stack([cols[c] for c in fit.names])
    proj = dummies @ np.linalg.lstsq(dummies, np.column_stack([design, y]), rcond=None)[0]
    xd, yd = design - proj[:, :4], y - proj[:, 4]
    beta = np.linalg.lstsq(xd, yd, rcond=None)[0]
    e, inv = yd - xd @ beta, np.linalg.inv(xd.T @ xd)
    s = np.array([(xd * e[:, None])[f == i].sum(0) for i in range(8)])
    # 12 + 8 - 1 levels, the 8 nested in the cluster not counted
    vcov = inv @ (s.T @ s) @ inv * (8 / 7) * ((n - 1) / (n - 4 - 11))
    np.testing.assert_allclose(fit.beta, beta, atol=1e-9)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.vcov)), np.sqrt(np.diag(vcov)), rtol=1e-8)
    table = {r["coef_name"]: r["estimate"] for r in fit.table(spark).collect()}
    assert all(table[c] is None for c in fit.dropped) and table["_n"] == n
    plain = linear.ols(df, "y", ["a", "twin", "b"], weight=None)
    assert plain.names == ["(Intercept)", "a", "b"] and plain.dropped == ("twin",)


def test_event_terms_are_the_fifty():
    t = linear.event_terms(12)
    assert len(t) == 50 and t[0] == "fee_chg_pos_F12" and t[12] == "fee_chg_pos" and t[24] == "fee_chg_pos_L12" and t[-1] == "fee_chg_neg_L12"
