"""Embedding whitening by spectrum slicing (operator 11).

A vector's entries become integers; the fit list is every vector that is whole.
Spark passes over the table four times, each a map over Arrow batches:

1. per dimension count, sum, least and greatest integer (exact);
2. the covariance, centred before multiplying: a task adds up one d x d matrix,
   and Spark sums the tasks' matrices by cell;
3. the covariance of the whitened rows, for the identity error;
4. the rows themselves.

Only d x d and k x k matrices come to the driver (d: entries of a vector).
There the leading eigenvalues are found by spectrum slicing:

* an LDL^T factorisation of ``V - s I`` (1 x 1 and 2 x 2 pivots) has as many
  positive pivots as V has eigenvalues above s; cutting intervals in half by
  that count isolates each of the k greatest eigenvalues;
* inside its interval Rayleigh quotient iteration converges cubically; should
  it leave the interval, the interval is cut further and it starts anew;
* counts just below and just above the value found certify its number.

Eigenvalues that do not part until the interval is ``CLUSTER`` of the greatest
wide share one subspace, found by inverse iteration on a block; any orthonormal
basis of it is right.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped, as are those of another length than the commonest (ties: the longer);
null and repeated ids and repeated rows are rows like any other; components
whose eigenvalue is no more than ``RANK`` of the greatest cannot be told from
zero and get no rows, so a table of equal rows, or an empty one, gives none;
entries of 2^38 or more raise an error; ``deviation`` is null where it does not
fit a signed 64-bit integer; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the entries' integer form.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
CLUSTER, RANK = 1e-12, 1e-11
_LIMIT = 1 << 45
_ALPHA = (1 + 17 ** 0.5) / 8


# ---------------------------------------------------------------- spectrum slicing (d x d, on the driver)

def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: the inertia of its LDL^T form with complete pivoting."""
    a, positive = a.copy(), 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        p = int(diagonal.argmax())
        off = size - np.diag(diagonal)
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[i, j] == 0:
            return positive
        if diagonal[p] >= _ALPHA * off[i, j]:
            rest = np.delete(np.arange(len(a)), p)
            positive += a[p, p] > 0
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:
            rest = np.delete(np.arange(len(a)), [i, j])
            positive += 1  # a 2 x 2 pivot is indefinite: one eigenvalue of each sign
            block, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
            a = (a + a.T) / 2
    return positive


def _solve(v: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, 1e-15, 1e-14, 1e-13):
        try:
            x = np.linalg.solve(v - (shift + nudge * scale) * np.eye(len(v)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise ArithmeticError("the shifted covariance could not be solved")


def _rayleigh(v: np.ndarray, low: float, high: float, start: np.ndarray, scale: float):
    """(value, vector) of the one eigenvalue in (low, high], or None if the iteration leaves the interval."""
    x = start / np.linalg.norm(start)
    for _ in range(3):
        x = _solve(v, (low + high) / 2, x, scale)
        x /= np.linalg.norm(x)
    value = float(x @ v @ x)
    for _ in range(20):
        if not low - CLUSTER * scale <= value <= high + CLUSTER * scale:
            return None
        rest = np.linalg.norm(v @ x - value * x)
        if rest <= 4e-15 * scale:
            return value, x
        x = _solve(v, value, x, scale)
        x /= np.linalg.norm(x)
        value = float(x @ v @ x)
    return (value, x) if np.linalg.norm(v @ x - value * x) <= 1e-12 * scale else None


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as columns;
    fewer where no more can be told from zero."""
    d = len(v)
    top = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(0)
    known: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in known:
            known[s] = positive_pivots(v - s * np.eye(d))
        return known[s]

    high = top * (1 + 1e-9)
    known[high] = 0
    pieces, found = [(0.0, high)], []
    known[0.0] = d  # rounding may leave an eigenvalue of zero on either side; RANK decides about those
    scale = top
    while pieces:
        low, high = pieces.pop()  # the rightmost interval
        m = above(low) - above(high)
        if m <= 0 or above(high) >= k or high <= RANK * scale / 2:
            continue
        middle = (low + high) / 2
        first = above(high) + 1
        if m == 1 and low > 0:
            got = _rayleigh(v, low, high, rng.standard_normal(d), scale)
            if got is not None:
                found.append((first, *got, low, high))
                continue
        if high - low <= CLUSTER * scale:
            x = np.linalg.qr(rng.standard_normal((d, m)))[0]
            for _ in range(4):
                x = np.linalg.qr(_solve(v, high + CLUSTER * scale, x, scale))[0]
            values = np.einsum("ij,ij->j", x, v @ x)
            order = np.argsort(-values)
            found += [(first + i, float(values[o]), x[:, o], low, high) for i, o in enumerate(order)]
            continue
        pieces += [(low, middle), (middle, high)]
    values, vectors = [], []
    for number, value, x, low, high in sorted(found, key=lambda f: f[0])[:k]:
        if values and value <= RANK * values[0]:
            break
        for u in vectors:
            x = x - (u @ x) * u
        x = x / np.linalg.norm(x)
        slack = max(64 * CLUSTER * scale, 1e-9 * value)
        if not above(value + slack) < number <= above(value - slack):
            raise ArithmeticError(f"the inertia counts do not certify eigenvalue {number}")
        values.append(value)
        vectors.append(x)
    return np.array(values), np.array(vectors).T if vectors else np.zeros((d, 0))


# ---------------------------------------------------------------- passes over the table

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: exact count and sums, eigenvalues and vectors, trace and identity error."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    greatest: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def integers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole and of the commonest length."""
    v = F.col("v")
    whole = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v")).where(
        v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    lengths = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return whole.where(F.size("v") == d).select("id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows' integers as a matrix (all rows have the same number)."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield _matrix(b.column(b.schema.get_field_index("x")))


def _centred(x: np.ndarray, quotient: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding an entry: whole parts are taken off as integers first."""
    return (x - quotient).astype(np.float64) - rest


def _summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of the size x size matrices that ``fn`` gives for a task's batches, added by cell in Spark."""
    def run(batches):
        total = None
        for x in _batches(batches):
            part = fn(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = (rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "c"))
             .groupBy("i", "j").agg(F.sum("c").alias("c")).collect())
    out = np.zeros((size + 1, size))
    for i, j, c in cells:
        out[i, j] = c
    return out


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Fits on all of ``integers``' rows."""
    def extremes(batches):
        n, total, least, most = 0, None, None, None
        for x in _batches(batches):
            low, high = x.min(0), x.max(0)
            if x.size and (int(low.min()) <= -_LIMIT or int(high.max()) >= _LIMIT):
                raise ValueError("entries of 2^38 or more cannot be whitened")
            part = x.sum(0, dtype=np.int64).astype(object)
            total, least, most = (part, low, high) if total is None else (total + part, np.minimum(least, low), np.maximum(most, high))
            n += len(x)
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                 pa.array(least, pa.int64()), pa.array(most, pa.int64())], ["i", "n", "s", "least", "most"])

    got = (rows.select("x").mapInArrow(extremes, "i int, n long, s decimal(38,0), least long, most long")
           .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    got = sorted(got, key=lambda r: r["i"])
    d, n = len(got), int(got[0]["n"]) if got else 0
    sums, least, most = (tuple(int(r[c]) for r in got) for c in ("s", "least", "most"))
    if not d:
        return Whitening(n, sums, least, most, np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    quotient, rest = _parts(n, sums)

    def products(x):
        z = _centred(x, quotient, rest)
        return z.T @ z

    v = _summed(rows, products, d)[:d] / n
    v = (v + v.T) / 2
    values, vectors = leading(v, min(k, d))
    m = len(values)
    if not m:
        return Whitening(n, sums, least, most, values, vectors, float(np.trace(v)), 0.0)
    to = vectors / np.sqrt(values)

    def whitened_products(x):
        w = _centred(x, quotient, rest) @ to
        return np.vstack((w.T @ w, w.sum(0)))

    second = _summed(rows, whitened_products, m)
    mean = second[m] / n
    error = float(np.abs(second[:m] / n - np.outer(mean, mean) - np.eye(m)).max())
    return Whitening(n, sums, least, most, values, vectors, float(np.trace(v)), error)


def _parts(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole part and rest in [0, 1)."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...], bound: int) -> list:
    """Exact sums of squares of n x - S, in 64-bit integers where ``bound`` shows that they fit."""
    if bound < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return [int(s) if s < 1 << 63 else None for s in (y * y).sum(1)]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation, whitened) of each row and component."""
    n, sums = model.n, model.sums
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, deviation long, w array<double>"
    if not len(model.values):
        return rows.sparkSession.createDataFrame([], f"id {kind.simpleString()}, component int, deviation long, whitened double")
    quotient, rest = _parts(n, sums)
    to = model.vectors / np.sqrt(model.values)
    widest = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(model.least, model.greatest, sums)]
    bound = max(sum(w * w for w in widest), max(abs(n * x) for x in model.least + model.greatest), max(map(abs, sums)))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(b.schema.get_field_index("x")))
                w = _centred(x, quotient, rest) @ to
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(_deviations(x, n, sums, bound), pa.int64()), flat],
                                                 ["id", "deviation", "w"])

    return rows.mapInArrow(run, schema).select("id", "deviation", F.posexplode("w").alias("p", "whitened")).select(
        "id", (F.col("p") + 1).alias("component"), "deviation", "whitened")


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row a kept vector and component: its whitened entry, with the exact deviation of the vector, the share of
    the variance that the component explains and the identity error of the fit."""
    rows = integers(vectors, id_column, vector_column)
    model = fit(rows, k)
    shares = [float(e / model.trace) for e in model.values]
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component")) if shares else F.lit(None).cast("double")
    return whiten(rows, model).select(
        F.col("id").alias(id_column), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
