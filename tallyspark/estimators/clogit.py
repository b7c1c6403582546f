"""Conditional logit by Newton's method (ES9), clustered sandwich (ES10), McFadden R² (ES11).

One row is one choice: the position of the alternative chosen, an array with the
regressors of every alternative, one after another, and a cluster.  A step is
one pass: a task works out the probabilities of its rows as matrices and adds up the
log-likelihood, the gradient and the Hessian; Spark adds the tasks' sums.  Only
those 1 + K + K² numbers reach the driver, which solves the K x K system.

A step that lowers the likelihood is halved.  Where the data separate the
choices -- the likelihood levels off while coefficients run away -- no finite
maximum exists: the fit stops with the names of the coefficients that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import COEF_SCHEMA, cross_products


class Separated(RuntimeError):
    """The choices can be told apart perfectly along ``names``; the likelihood has no maximum."""

    def __init__(self, names: list[str]):
        super().__init__(f"the choices are separated: no finite estimate of {', '.join(names)}")
        self.names = names


def utilities(signal: list, time, experience, surprise: list | None = None):
    """The study's regressors as an array column: of each alternative its signal, signal x experience and, where given, its
    surprise, then alternative-specific constants and time trends for all but the first alternative.  Returns (column, names
    of the generic ones); alternatives are in the order of the lists."""
    n = len(signal)
    names = ["signal", "signal_x_exp"] + (["surpr"] if surprise else [])
    parts = []
    for j, s in enumerate(signal):
        parts += [s, s * experience] + ([surprise[j]] if surprise else [])
        parts += [F.lit(float(j == i)) for i in range(1, n)] + [time if j == i else F.lit(0.0) for i in range(1, n)]
    return F.array(*[p.cast("double") for p in parts]), names


def _parts(batch: pa.RecordBatch, k: int, beta: np.ndarray):
    """(regressors (n, J, k), chosen, utilities, probabilities, log of the chosen one's) of a batch's rows."""
    x = np.asarray(batch.column(batch.schema.get_field_index("x")).flatten()).reshape(batch.num_rows, -1, k)
    chosen = np.asarray(batch.column(batch.schema.get_field_index("chosen")))
    u = x @ beta
    top = u.max(1, keepdims=True)
    e = np.exp(u - top)
    total = e.sum(1, keepdims=True)
    own = u[np.arange(len(u)), chosen] - top[:, 0] - np.log(total[:, 0])
    return x, chosen, e / total, own


def _step(d: DataFrame, k: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(log-likelihood, gradient, Hessian, choices) at ``beta``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + k + k * k)
        for b in batches:
            if b.num_rows:
                x, chosen, p, own = _parts(b, k, beta)
                mean = np.einsum("nj,njk->nk", p, x)
                second = np.einsum("nj,njk,njl->kl", p, x, x) - mean.T @ mean
                total += np.concatenate(([len(p), own.sum()], (x[np.arange(len(x)), chosen] - mean).sum(0), second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    sums = d.select("x", "chosen").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    s = np.zeros(2 + k + k * k)
    for i, v in sums.collect():
        s[i] = v
    return s[1], s[2:2 + k], -s[2 + k:].reshape(k, k), int(s[0])


def _scores(d: DataFrame, k: int, beta: np.ndarray) -> DataFrame:
    """(cluster, s0, s1, ...): the choices' scores."""
    kind = d.schema["cluster"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, chosen, p, _ = _parts(b, k, beta)
                s = x[np.arange(len(x)), chosen] - np.einsum("nj,njk->nk", p, x)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("cluster")), *[pa.array(s[:, i]) for i in range(k)]],
                                                 ["cluster", *[f"s{i}" for i in range(k)]])

    return d.mapInArrow(run, ", ".join([f"cluster {kind}", *[f"s{i} double" for i in range(k)]]))


def fit(df: DataFrame, x, chosen, names: list[str], *, cluster=None, name: str = "clogit", tol: float = 1e-8, max_iter: int = 50):
    """Fits choices by their regressors ``x`` (array: the first alternative's in the order of ``names``, then the next one's)
    and the position ``chosen`` from 0.  Rows with a NULL regressor take no part.

    Returns (coefficient table, info: ll, ll0, pseudo_r2, iterations, n).  Standard errors are clustered (HC0, G / (G - 1))
    where ``cluster`` is given, else from the Hessian; pseudo R² is against the shares of the alternatives."""
    k = len(names)
    d = df.select(x.alias("x"), chosen.cast("int").alias("chosen"), (cluster if cluster is not None else F.lit(0)).alias("cluster"))
    d = d.where(F.col("chosen").isNotNull() & ~F.exists("x", lambda v: v.isNull())).persist()
    beta, level = np.zeros(k), 0
    ll, g, h, n = _step(d, k, beta)
    for it in range(max_iter):
        if not n:
            raise ValueError("no choices to fit")
        delta = np.linalg.lstsq(-h, g, rcond=1e-12)[0]
        part = 1.0
        while True:
            new = _step(d, k, beta + part * delta)
            if np.isfinite(new[0]) and new[0] >= ll - 1e-12 * abs(ll):
                break
            part /= 2
            if part < 1e-6:
                raise RuntimeError("no step along Newton's direction raises the likelihood")
        gain, beta = new[0] - ll, beta + part * delta
        ll, g, h, n = new
        if np.max(np.abs(part * delta)) < tol * max(1.0, np.max(np.abs(beta))):
            break
        # the likelihood stands still although coefficients still move by whole units
        level = level + 1 if gain < 1e-3 * max(1.0, abs(ll)) and np.max(np.abs(delta)) > 0.5 else 0
        if level >= 5:
            raise Separated([names[i] for i in np.flatnonzero(np.abs(delta) > 0.1)])
    else:
        raise RuntimeError(f"the coefficients still move by {np.max(np.abs(delta)):.2g} after {max_iter} steps")
    inv = np.linalg.pinv(-h)
    vcov = inv
    if cluster is not None:
        s = _scores(d, k, beta).groupBy("cluster").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
        meat = cross_products(s.withColumn("one", F.lit(1.0)), [*[f"s{i}" for i in range(k)], "one"])
        groups = meat[k, k]
        vcov = inv @ meat[:k, :k] @ inv * (groups / (groups - 1) if groups > 1 else 1.0)
    shares = [r["n"] for r in d.groupBy("chosen").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row an alternative
    ll0 = float(sum(m * np.log(m / n) for m in shares))
    d.unpersist()
    se = np.sqrt(np.clip(np.diag(vcov), 0, None))
    info = {"ll": float(ll), "ll0": ll0, "pseudo_r2": 1 - float(ll) / ll0 if ll0 else None, "iterations": it + 1, "n": n}
    rows = [(name, c, float(b), float(e)) for c, b, e in zip(names, beta, se)]
    rows += [(name, "num_obs", float(n), None), (name, "pseudo_r2", info["pseudo_r2"], None)]
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA), info
