"""Conditional logit against dense numpy: gradient, errors, pseudo R², separation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.estimators import clogit

J = 3


def choices(n=300, seed=1):
    rng = np.random.default_rng(seed)
    user, signal, surprise = rng.integers(0, 20, n), rng.random((n, J)), rng.standard_normal((n, J)) * 0.3
    exp, time = rng.random(n) * 2, rng.random(n)
    u = 1.2 * signal - 0.4 * signal * exp[:, None] + 0.7 * surprise + np.array([0, 0.3, -0.2]) + np.outer(time, [0, 0.5, 0.1])
    chosen = (u + rng.gumbel(size=u.shape)).argmax(1)
    x = np.zeros((n, J, 3 + 2 * (J - 1)))
    x[:, :, 0], x[:, :, 1], x[:, :, 2] = signal, signal * exp[:, None], surprise
    for j in range(1, J):
        x[:, j, 2 + j], x[:, j, 1 + J + j] = 1, time
    rows = [(int(user[i]), int(chosen[i]), float(exp[i]), float(time[i]), *map(float, signal[i]), *map(float, surprise[i])) for i in range(n)]
    return rows, x, chosen, user


def names():
    return ["signal", "signal_x_exp", "surpr"] + [f"{p}:{j}" for p in ("(Intercept)", "time") for j in range(1, J)]


def frame(spark, rows):
    return spark.createDataFrame(rows, ["user", "chosen", "exp", "time", *[f"s{j}" for j in range(J)], *[f"r{j}" for j in range(J)]]).repartition(4)


def columns():
    x, generic = clogit.utilities([F.col(f"s{j}") for j in range(J)], F.col("time"), F.col("exp"), [F.col(f"r{j}") for j in range(J)])
    assert generic == ["signal", "signal_x_exp", "surpr"]
    return x


def test_estimates_errors_and_fit_match_numpy(spark):
    rows, x, chosen, user = choices()
    df = frame(spark, [*rows, (1, 0, None, 0.5, *[0.1] * (2 * J))])  # a row without experience takes no part
    table, info = clogit.fit(df, columns(), F.col("chosen"), names(), cluster=F.col("user"), name="m")
    got = {r["coef_name"]: r for r in table.collect()}
    beta = np.array([got[c]["estimate"] for c in names()])
    u = x @ beta
    p = np.exp(u) / np.exp(u).sum(1, keepdims=True)
    n = len(rows)
    scores = x[np.arange(n), chosen] - np.einsum("nj,njk->nk", p, x)
    assert np.abs(scores.sum(0)).max() < 1e-6  # the gradient is zero
    ll = np.log(p[np.arange(n), chosen]).sum()
    share = np.bincount(chosen) / n
    assert abs(info["ll"] - ll) < 1e-8 and abs(info["pseudo_r2"] - (1 - ll / (np.bincount(chosen) * np.log(share)).sum())) < 1e-10
    mean = np.einsum("nj,njk->nk", p, x)
    inv = np.linalg.inv(np.einsum("nj,njk,njl->kl", p, x, x) - mean.T @ mean)
    s = np.array([scores[user == c].sum(0) for c in np.unique(user)])
    vcov = inv @ (s.T @ s) @ inv * len(s) / (len(s) - 1)
    np.testing.assert_allclose([got[c]["serr"] for c in names()], np.sqrt(np.diag(vcov)), rtol=1e-6)
    assert got["num_obs"]["estimate"] == n == info["n"]


def test_separated_choices_are_reported(spark):
    rows, *_ = choices(80, 2)
    rows = [(u, int(np.argmax(s[:J])), e, t, *s) for u, _, e, t, *s in rows]  # the greatest signal is always chosen
    with pytest.raises(clogit.Separated) as error:
        clogit.fit(frame(spark, rows), columns(), F.col("chosen"), names())
    assert "signal" in error.value.names


def test_no_choices_is_an_error(spark):
    with pytest.raises(ValueError, match="no choices"):
        clogit.fit(frame(spark, choices(5)[0]).where("false"), columns(), F.col("chosen"), names())
