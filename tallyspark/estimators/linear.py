"""Distributed least squares (ES1-ES6, ES12).

Every pass is one aggregation: the K x K cross products, the K scores per
cluster, or the group means of a fixed effect.  Only K x K matrices reach the
driver, where numpy solves them.  Fixed effects are absorbed by alternating
projections (group means joined back: a partial aggregate plus a join AQE
can split when one level is hot, never one task per level); the demeaned
frame is checkpointed every few sweeps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..operators.scan import changes, join_on, slices
from ..session import cut_lineage, stored

COEF_SCHEMA = "regression_name string, coef_name string, estimate double, serr double"


@dataclass
class Fit:
    name: str
    names: list
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    r2: float
    df_resid: int
    #: Regressors left out because the ones before them (and the effects) already give them.
    dropped: tuple = ()

    def table(self, spark) -> DataFrame:
        se = np.sqrt(np.clip(np.diag(self.vcov), 0, None))
        rows = [(self.name, n, float(b), float(s)) for n, b, s in zip(self.names, self.beta, se)]
        rows += [(self.name, n, None, None) for n in self.dropped]
        rows += [(self.name, "_n", float(self.n), None), (self.name, "_r2", float(self.r2), None)]
        return spark.createDataFrame(rows, COEF_SCHEMA)


def cross_products(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns, one row a column and one more for plain sums: a matrix product a batch, the
    tasks' matrices added by cell."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.asarray(c, dtype=np.float64) for c in b.columns])
                part = np.vstack((x.T @ x, x.sum(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = (df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "i int, row array<double>")
             .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    out = np.zeros((len(cols) + 1, len(cols)))
    for i, j, v in cells:
        out[i, j] = v
    return out


def independent(xx: np.ndarray, least: np.ndarray) -> list[int]:
    """The columns that the ones before them do not give: a Cholesky factorisation of the cross products in the order given,
    which leaves a column out when what is left of its square sum is at most ``least``."""
    kept: list[int] = []
    factor = np.zeros((len(xx), 0))  # rows: columns of the model, columns: kept ones
    for j in range(len(xx)):
        rest = xx[j, j] - factor[j] @ factor[j]
        if rest > least[j]:
            new = (xx[:, j] - factor @ factor[j]) / math.sqrt(rest)
            factor = np.column_stack((factor, new))
            kept.append(j)
    return kept


def ols(df: DataFrame, y: str, xs: list[str], *, name: str = "ols", intercept: bool = True,
        cluster: str | None = None, absorbed_dof: int = 0, centred_tss: bool = True,
        tss_override: float | None = None, weight: str | None = None, scale: dict[str, float] | None = None) -> Fit:
    """ES1: OLS with classical or one-way clustered (ES4) errors, and R² (ES5).

    Collinear regressors are left out, the later of a set first, and named in ``dropped``; ``scale`` has the square sums
    that they are measured against, where they are not the columns' own (absorbed effects)."""
    d = df.select(y, *xs, *([cluster] if cluster else []), *([weight] if weight else [])).dropna()
    cols = list(xs)
    if intercept:
        d = d.withColumn("__one", F.lit(1.0))
        cols = ["__one"] + cols
    wide = d
    if weight:
        wide = d.select(*[(F.col(c) * F.sqrt(weight)).alias(c) for c in [*cols, y]], F.sqrt(weight).alias("__w"))
    else:
        wide = d.select(*cols, y, F.lit(1.0).alias("__w"))
    both = cross_products(wide.select(*cols, y, "__w"), [*cols, y, "__w"])
    k = len(cols)
    n = d.count() if weight else int(round(both[k + 1, k + 1]))
    full, xy_full, syy, sy, n_w = both[:k, :k], both[:k, k], both[k, k], both[k, k + 1], both[k + 1, k + 1]
    least = np.array([1e-10 * (scale or {}).get(c, full[i, i]) for i, c in enumerate(cols)])
    kept = independent(full, least)
    dropped = tuple(c for i, c in enumerate(cols) if i not in kept)
    cols = [cols[i] for i in kept]
    xx, xy, k = full[np.ix_(kept, kept)], xy_full[kept], len(kept)
    inv = np.linalg.inv(xx) if k else xx
    beta = inv @ xy
    ssr = syy - 2 * beta @ xy + beta @ xx @ beta
    tss = tss_override if tss_override is not None else (syy - sy ** 2 / n_w if centred_tss else syy)
    r2 = 1 - ssr / tss if tss else float("nan")
    dof = n - k - absorbed_dof
    if cluster is None:
        vcov = inv * (ssr / dof)
    else:
        e = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
        scores = d.groupBy(cluster).agg(*[F.sum(F.col(c) * e).alias(f"s{i}") for i, c in enumerate(cols)])
        meat = cross_products(scores.withColumn("__one", F.lit(1.0)), [*[f"s{i}" for i in range(k)], "__one"])
        g = meat[k, k]
        adj = (g / (g - 1)) * ((n - 1) / (n - k - absorbed_dof)) if g > 1 else 1.0
        vcov = adj * inv @ meat[:k, :k] @ inv
    names = ["(Intercept)" if c == "__one" else c for c in cols]
    return Fit(name, names, beta, vcov, n, r2, dof, dropped)


def drop_singletons(df: DataFrame, fes: list[str]) -> DataFrame:
    """ES3: drop rows whose level of any fixed effect has one row, repeated to a fixed point.

    One grouped count per effect decides whether anything must go; only then
    is the frame filtered (semi joins) and checkpointed, round by round.
    """
    def has_singletons(frame):
        return any(not frame.groupBy(f).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") == 1).isEmpty()
                   for f in fes)

    cur = df
    while has_singletons(cur):
        for f in fes:
            cnt = cur.groupBy(f).agg(F.count(F.lit(1)).alias("__c"))
            cur = cur.join(cnt.where(F.col("__c") > 1).select(f), f, "left_semi")
        cur = cut_lineage(cur)
    return cur


#: Up to so many levels and cells the normal equations of the levels are solved on the driver; beyond, by conjugate gradients.
DIRECT_LEVELS, DIRECT_CELLS = 2_048, 200_000
#: Up to so many levels beside those of the largest effect, that effect is taken out of the equations in the tasks.
REST_LEVELS = 1_024


def cell_table(df: DataFrame, cols: list[str], fes: list[str]) -> DataFrame:
    """One row a combination of levels: its rows ``__n`` and the sums ``__s`` of ``cols``, with partial aggregation, so a
    hot cell is pre-summed in every task."""
    return df.groupBy(*fes).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(cols)]).select(
        *fes, "__n", F.array(*[F.coalesce(f"__s{i}", F.lit(0.0)) for i in range(len(cols))]).alias("__s"))


def solve_levels(cells: DataFrame, fes: list[str], k: int, *, tol: float = 1e-10, max_rounds: int = 200, direct: bool | None = None,
                 seen: dict | None = None, centred: bool = True) -> dict[str, DataFrame]:
    """The least-squares levels of all effects for each of the k columns of ``cells``: effect -> (level, ``__n`` rows, ``__a`` array).

    The levels solve the normal equations, cell counts by cell sums.  They are
    identified up to one constant an effect in each *connected set* of levels (levels that share cells, directly or over others),
    so the second and later effects have mean zero over the levels of each set and the first carries the level; three
    and more effects that are tied in further ways get the smallest solution.

    At most ``DIRECT_LEVELS`` levels and ``DIRECT_CELLS`` cells are solved on the driver (both are counted first).  Beyond that,
    if the effects other than the largest have at most ``REST_LEVELS`` levels, the tasks take the largest one out of the
    equations and the driver solves the rest; else conjugate gradients work on the level tables, scaled by the levels' counts: a round is one join and aggregation of the
    cells an effect and one small sum, and only the level tables are checkpointed.  ``direct`` chooses the way in tests.
    ``seen`` takes the number of rounds.  Without ``centred`` any solution may be given outside the driver's way: sums of
    a row's levels are the same, and the connected sets need not be found.
    """
    direct, most = _way(cells, fes, direct)
    if direct:
        return _solve_directly(cells, fes, k)
    if most is not None:
        tables = _solve_by_elimination(cells, fes, k, most)
    else:
        tables = _solve_by_gradients(cells, fes, k, tol, max_rounds, seen)
    return _centred_in_sets(cells, fes, k, tables) if centred else tables


def _way(cells: DataFrame, fes: list[str], direct: bool | None) -> tuple[bool, str | None]:
    """Whether the driver solves the levels, and else the effect that the tasks take out, if the others have few levels."""
    if direct is not None:
        return direct, None
    sizes = cells.agg(F.count(F.lit(1)).alias("c"), *[(F.countDistinct(f) + F.count_if(F.col(f).isNull())).alias(f"l{i}") for i, f in enumerate(fes)]).first()
    levels = [sizes[f"l{i}"] for i in range(len(fes))]
    if sizes["c"] <= DIRECT_CELLS and sum(levels) <= DIRECT_LEVELS:
        return True, None
    return False, fes[levels.index(max(levels))] if len(fes) > 1 and sum(levels) - max(levels) <= REST_LEVELS else None


def _level_table(like: DataFrame, f: str, rows: list[tuple], ddl: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, f"`{f}` {like.schema[f].dataType.simpleString()}, {ddl}")


def _rest_levels(cells: DataFrame, fes: list[str], k: int, most: str) -> tuple[list[list], np.ndarray]:
    """The levels of the effects other than ``most``: their names, effect by effect, and their values, a row each.  ``most`` is
    taken out of the normal equations: its own block is diagonal, so each of its levels adds one outer product to the equations
    of the others (Schur complement), which tasks sum up and the driver solves."""
    rest = [f for f in fes if f != most]
    names = [[r[0] for r in cells.select(f).distinct().collect()] for f in rest]
    first = np.cumsum([0] + [len(m) for m in names])
    size, m = int(first[-1]), len(rest)

    frame = _numbered(cells, rest, names)  # at most REST_LEVELS rows
    frame = frame.select(F.col(most).alias("__u"), F.array(*[F.col(f"__i{i}") for i in range(m)]).alias("__at"), "__n", "__s")
    rows = frame.repartition("__u").sortWithinPartitions("__u")

    def equations(batches):
        total = held = None  # held: key, counts by level, sums and rows of the level that the last batch ended in

        def add(counts, sums, n):
            total[:, :size] -= counts.T @ (counts / n[:, None])
            total[:, size:] -= counts.T @ (sums / n[:, None])

        for batch in slices(batches, max(64, (1 << 21) // size)):
            if total is None:
                total = np.zeros((size, size + k))
            at = np.asarray(batch.column(1).flatten()).reshape(-1, m)
            n, s = np.asarray(batch.column(2), dtype=float), np.asarray(batch.column(3).flatten()).reshape(-1, k)
            for i in range(m):
                np.add.at(total[:, size:], at[:, i], s)
                for j in range(m):
                    np.add.at(total, (at[:, i], at[:, j]), n)
            new = changes(batch, ["__u"])
            level = np.cumsum(new) - 1
            counts, sums, weight = np.zeros((level[-1] + 1, size)), np.zeros((level[-1] + 1, k)), np.zeros(level[-1] + 1)
            for i in range(m):
                np.add.at(counts, (level, at[:, i]), n)
            np.add.at(sums, level, s)
            np.add.at(weight, level, n)
            if held is not None:
                if held[0] == batch.column(0)[0].as_py():
                    counts[0] += held[1]
                    sums[0] += held[2]
                    weight[0] += held[3]
                else:
                    add(held[1][None], held[2][None], np.array([held[3]]))
            add(counts[:-1], sums[:-1], weight[:-1])
            held = batch.column(0)[batch.num_rows - 1].as_py(), counts[-1].copy(), sums[-1].copy(), weight[-1]
        if total is not None:
            add(held[1][None], held[2][None], np.array([held[3]]))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(batches):
        sums: dict = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.asarray(row.values)
                sums[i] = sums[i] + value if i in sums else value.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(equations, "i int, row array<double>").repartition("i").mapInArrow(added, "i int, row array<double>")
    both = np.zeros((size, size + k))
    for i, row in parts.collect():
        both[i] = row
    scale = 1 / np.sqrt(np.maximum(np.diag(both), 1e-12 * np.abs(both[:, :size]).max() if size else 0.0))
    return names, np.linalg.lstsq(both[:, :size] * scale[:, None] * scale, both[:, size:] * scale[:, None], rcond=1e-12)[0] * scale[:, None]


def _numbered(df: DataFrame, fes: list[str], names: list[list]) -> DataFrame:
    """Rows with the numbers ``__i0``, ``__i1``, ... of their levels among those of all ``fes`` (broadcast: a row a level)."""
    first = np.cumsum([0] + [len(m) for m in names])
    for i, f in enumerate(fes):
        df = join_on(df, F.broadcast(_level_table(df, f, [(level, int(first[i] + j)) for j, level in enumerate(names[i])], f"__i{i} int")), [f])
    return df


def _solve_by_elimination(cells: DataFrame, fes: list[str], k: int, most: str) -> dict[str, DataFrame]:
    """All levels, those of ``most`` as the means of what the others (:func:`_rest_levels`) leave."""
    rest = [f for f in fes if f != most]
    names, x = _rest_levels(cells, fes, k, most)
    return _largest_levels(cells, fes, k, most, names, x)


def _largest_levels(cells: DataFrame, fes: list[str], k: int, most: str, names: list[list], x: np.ndarray) -> dict[str, DataFrame]:
    rest, out, frame, at = [f for f in fes if f != most], {}, cells, 0
    m = len(rest)
    for i, f in enumerate(rest):
        solved = _level_table(cells, f, [(level, x[at + j].tolist()) for j, level in enumerate(names[i])], f"__a{i} array<double>")
        at += len(names[i])
        out[f] = join_on(solved.withColumnRenamed(f"__a{i}", "__a"), cells.groupBy(f).agg(F.sum("__n").alias("__n")), [f]).select(f, "__n", "__a")
        frame = join_on(frame, F.broadcast(solved), [f])
    left = [F.sum(F.col("__s")[c] - F.col("__n") * sum(F.col(f"__a{i}")[c] for i in range(m))).alias(f"__x{c}") for c in range(k)]
    got = frame.groupBy(most).agg(F.sum("__n").alias("__n"), *left)
    out[most] = cut_lineage(got.select(most, "__n", F.array(*[F.col(f"__x{c}") / F.col("__n") for c in range(k)]).alias("__a")))
    return out


def _solve_directly(cells: DataFrame, fes: list[str], k: int) -> dict[str, DataFrame]:
    rows = cells.select(*[F.col(f).alias(f"__f{i}") for i, f in enumerate(fes)], "__n", "__s").collect()
    names: list[dict] = [{} for _ in fes]
    at = np.array([[m.setdefault(r[i], len(m)) for i, m in enumerate(names)] for r in rows], np.int64).reshape(len(rows), len(fes))
    first = np.cumsum([0] + [len(m) for m in names])
    at = at + first[:-1]
    n, sums, size = np.array([r["__n"] for r in rows], float), np.array([r["__s"] for r in rows], float).reshape(len(rows), k), int(first[-1])
    a, b = np.zeros((size, size)), np.zeros((size, k))
    for i in range(len(fes)):
        np.add.at(b, at[:, i], sums)
        for j in range(len(fes)):
            np.add.at(a, (at[:, i], at[:, j]), n)
    sets = np.arange(size)  # connected sets: the smallest level index reached
    while True:
        least = sets[at].min(axis=1)
        new = sets.copy()
        for i in range(len(fes)):
            np.minimum.at(new, at[:, i], least)
        if (new == sets).all():
            break
        sets = new
    counts = np.diag(a).copy()
    # the effect with the most levels is taken out of the equations: its own block is diagonal
    most = int(np.argmax([len(m) for m in names]))
    own = (np.arange(size) >= first[most]) & (np.arange(size) < first[most + 1])
    rest, cross = a[np.ix_(~own, ~own)], a[np.ix_(~own, own)]
    left = rest - (cross / counts[own]) @ cross.T
    right = b[~own] - (cross / counts[own]) @ b[own]
    effect_of, held = np.searchsorted(first, np.arange(size), "right")[~own] - 1, sets[~own]
    for s in np.unique(sets):
        for i in set(effect_of.tolist()):  # the sum of the set's levels of this effect is to be zero
            v = ((held == s) & (effect_of == i)).astype(float)
            left += np.outer(v, v) * counts.mean() / max(v.sum(), 1.0)
    x = np.zeros((size, k))
    if len(left):
        regular = np.linalg.cond(left) < 1e13
        x[~own] = np.linalg.solve(left, right) if regular else np.linalg.lstsq(left, right, rcond=1e-12)[0]
    x[own] = (b[own] - cross.T @ x[~own]) / counts[own][:, None]
    for s in np.unique(sets):
        for i in range(1, len(fes)):
            mine = np.flatnonzero(sets[first[i]:first[i + 1]] == s) + first[i]
            mean = x[mine].mean(axis=0) if len(mine) else 0.0
            x[mine] -= mean
            x[np.flatnonzero(sets[:first[1]] == s)] += mean
    out, spark = {}, cells.sparkSession
    for i, f in enumerate(fes):
        levels = [(level, int(counts[first[i] + j]), x[first[i] + j].tolist(), int(sets[first[i] + j])) for level, j in names[i].items()]
        kind = cells.schema[f].dataType.simpleString()
        out[f] = spark.createDataFrame(levels, f"`{f}` {kind}, __n long, __a array<double>, __set long")
    return out


def _solve_by_gradients(cells: DataFrame, fes: list[str], k: int, tol: float, max_rounds: int, seen: dict | None) -> dict[str, DataFrame]:
    def zip_with(a, b, fn):
        return F.zip_with(F.col(a), F.col(b), fn)

    def sums(expr, name):
        return [F.sum(expr[i]).alias(f"{name}{i}") for i in range(k)]

    tables = {}
    for f in fes:
        t = cells.groupBy(f).agg(F.sum("__n").alias("__n"), *sums(F.col("__s"), "__b")).select(f, "__n", F.array(*[f"__b{i}" for i in range(k)]).alias("__r"))
        tables[f] = cut_lineage(t.select("*", F.array(*[F.lit(0.0)] * k).alias("__a"), F.transform("__r", lambda r: r / F.col("__n")).alias("__p")))
    start = None
    for rounds in range(1, max_rounds + 1):
        frame = cells.select(*fes, "__n")
        for i, g in enumerate(fes):
            frame = join_on(frame, tables[g].select(g, F.col("__p").alias(f"__p{i}")), [g])
        total = F.array(*[sum(F.col(f"__p{j}")[i] for j in range(len(fes))) * F.col("__n") for i in range(k)])
        frame = frame.select(*fes, total.alias("__t"))
        for f in fes:
            q = frame.groupBy(f).agg(*sums(F.col("__t"), "__q")).select(f, F.array(*[f"__q{i}" for i in range(k)]).alias("__q"))
            tables[f] = cut_lineage(join_on(tables[f], q, [f]))
        parts = None
        for f in fes:
            r, p, q, n = F.col("__r"), F.col("__p"), F.col("__q"), F.col("__n")
            part = tables[f].agg(*[x for i in range(k) for x in (
                F.sum(p[i] * q[i]).alias(f"pq{i}"), F.sum(r[i] * r[i] / n).alias(f"rr{i}"),
                F.sum(r[i] * q[i] / n).alias(f"rq{i}"), F.sum(q[i] * q[i] / n).alias(f"qq{i}"))])
            parts = part if parts is None else parts.unionAll(part)
        got = {c: sum(row[c] or 0.0 for row in rows) for rows in [parts.collect()] for c in parts.columns}
        rr = np.array([got[f"rr{i}"] for i in range(k)])
        start = rr if start is None else start
        step = np.array([got[f"rr{i}"] / got[f"pq{i}"] if got[f"pq{i}"] > 0 else 0.0 for i in range(k)])
        after = np.array([max(0.0, rr[i] - 2 * step[i] * got[f"rq{i}"] + step[i] ** 2 * got[f"qq{i}"]) for i in range(k)])
        turn = [float(a / b) if b > 0 else 0.0 for a, b in zip(after, rr)]
        moves, turns = F.array(*[F.lit(float(s)) for s in step]), F.array(*[F.lit(t) for t in turn])
        for f in fes:
            t = tables[f].select(f, "__n", F.zip_with("__r", F.zip_with(moves, "__q", lambda s, q: s * q), lambda r, q: r - q).alias("__r"),
                                 F.zip_with("__a", F.zip_with(moves, "__p", lambda s, p: s * p), lambda a, p: a + p).alias("__a"), "__p")
            tables[f] = t.withColumn("__p", F.zip_with(F.transform("__r", lambda r: r / F.col("__n")),
                                                       F.zip_with(turns, "__p", lambda s, p: s * p), lambda r, p: r + p))
        if (after <= tol ** 2 * start).all():
            break
    else:
        raise RuntimeError(f"the fixed effects still move after {max_rounds} rounds")
    if seen is not None:
        seen["rounds"] = rounds
    return {f: cut_lineage(t.select(f, "__n", "__a")) for f, t in tables.items()}


def _centred_in_sets(cells: DataFrame, fes: list[str], k: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Later effects with mean zero in each connected set, the first effect taking their means."""
    def node(i, f):
        return F.xxhash64(F.lit(i), F.col(f).cast("string"), F.col(f).isNull())

    if len(fes) == 1:
        return {fes[0]: tables[fes[0]].withColumn("__set", node(0, fes[0]))}
    edges = None
    for i, f in enumerate(fes[1:], 1):
        e = cells.select(node(0, fes[0]).alias("src"), node(i, f).alias("dst")).distinct()
        edges = e if edges is None else edges.unionAll(e)
    sets = connected_components(edges).select(F.col("node").alias("__node"), F.col("component").alias("__set"))
    out = {f: t.withColumn("__node", node(i, f)).join(sets, "__node").drop("__node") for i, (f, t) in enumerate(tables.items())}
    shift = None
    for f in fes[1:]:
        m = out[f].groupBy("__set").agg(F.array(*[F.avg(F.col("__a")[i]) for i in range(k)]).alias("__m"))
        out[f] = cut_lineage(out[f].join(m, "__set").select(f, "__n", F.zip_with("__a", "__m", lambda a, b: a - b).alias("__a"), "__set"))
        shift = m if shift is None else shift.join(m.withColumnRenamed("__m", "__m2"), "__set").select(
            "__set", F.zip_with("__m", "__m2", lambda a, b: a + b).alias("__m"))
    f = fes[0]
    out[f] = cut_lineage(out[f].join(shift, "__set").select(f, "__n", F.zip_with("__a", "__m", lambda a, b: a + b).alias("__a"), "__set"))
    return out


def demean(df: DataFrame, cols: list[str], fes: list[str], *, tol: float = 1e-10, max_rounds: int = 200, direct: bool | None = None) -> DataFrame:
    """ES2: remove fixed effects.  The facts are read twice: once to sum them up per cell, once to take the levels off
    (:func:`solve_levels`; one effect: the group means)."""
    if len(fes) == 1:
        levels = {fes[0]: df.groupBy(*fes).agg(F.array(*[F.avg(c) for c in cols]).alias("__a"))}
    else:
        cells = stored(cell_table(df, cols, fes), "cells")
        direct, most = _way(cells, fes, direct)
        if direct:
            found = [t.select(f, "__a").collect() for f, t in _solve_directly(cells, fes, len(cols)).items()]  # made on the driver
            return _taken_off(df, cols, fes, [[r[0] for r in rows] for rows in found], np.array([r[1] for rows in found for r in rows]))
        if most is not None:
            return _without_largest(df, cells, cols, fes, most)
        levels = solve_levels(cells, fes, len(cols), tol=tol, max_rounds=max_rounds, direct=False, centred=False)
    frame, add = df, [F.lit(0.0) for _ in cols]
    for j, f in enumerate(fes):
        frame = join_on(frame, levels[f].select(f, F.col("__a").alias(f"__a{j}")), [f], "left")
        add = [x + F.col(f"__a{j}")[i] for i, x in enumerate(add)]
    # stored, as the plan of many differences is slow to optimise
    return stored(frame.select(*[x for x in df.columns if x not in cols], *[(F.col(c) - add[i]).alias(c) for i, c in enumerate(cols)]), "demeaned")


def _taken_off(df: DataFrame, cols: list[str], fes: list[str], names: list[list], x: np.ndarray, *, by: str | None = None, also: str | None = None) -> DataFrame:
    """``cols`` less the levels ``x`` of the effects ``fes``, in the tasks; then less the column ``also`` (an array), or less the
    means over the rows of each ``by``, which lie together (a task holds one at a time)."""
    others, m = [c for c in df.columns if c not in cols and c != also], len(fes)
    rows = _numbered(df, fes, names)
    if by is not None:
        rows = rows.repartition(by).sortWithinPartitions(by)
    schema = T.StructType([*[df.schema[c] for c in others], *[T.StructField(c, T.DoubleType()) for c in cols]])

    def column(batch, c):
        return batch.column(batch.schema.get_field_index(c))

    def less(batch):
        given = [column(batch, c).cast(pa.float64()) for c in cols]
        v = np.column_stack([np.asarray(g.fill_null(0.0)) for g in given])
        for i in range(m):
            v -= x[np.asarray(column(batch, f"__i{i}"))]
        if also is not None:
            v -= np.asarray(column(batch, also).flatten()).reshape(len(v), -1)
        if by is not None:
            starts = np.flatnonzero(changes(batch, [by]))
            size = np.diff(np.append(starts, len(v)))
            v -= np.repeat(np.add.reduceat(v, starts, axis=0) / size[:, None], size, axis=0)
        empty = [np.asarray(g.is_null()) for g in given]
        return pa.RecordBatch.from_arrays([*[column(batch, c) for c in others], *[pa.array(np.ascontiguousarray(v[:, i]), mask=empty[i]) for i in range(len(cols))]],
                                          names=[f.name for f in schema])

    def run(batches):
        held = None
        for batch in slices(batches):
            if by is not None:
                if held is not None:
                    batch = pa.concat_batches([held, batch])
                whole = int(np.flatnonzero(changes(batch, [by]))[-1])  # the last one may go on
                held, batch = batch.slice(whole), batch.slice(0, whole)
            if batch.num_rows:
                yield less(batch)
        if held is not None:
            yield less(held)

    return rows.mapInArrow(run, schema)


#: Rows of a level beyond which they are not dealt by the level: there are at most (rows / HOT_ROWS) such levels.
HOT_ROWS = 1 << 16


def _without_largest(df: DataFrame, cells: DataFrame, cols: list[str], fes: list[str], most: str) -> DataFrame:
    """``cols`` less all levels, where those of the effect ``most`` are many: they are never a table, as their rows are
    dealt by them with the columns as they came, and means are taken off in the tasks.  Levels with more than ``HOT_ROWS``
    rows would be one task: theirs are broadcast and their rows stay where they are."""
    rest, k = [f for f in fes if f != most], len(cols)
    names, x = _rest_levels(cells, fes, k, most)
    hot = cells.groupBy(most).agg(F.sum("__n").alias("__c")).where(F.col("__c") > HOT_ROWS).select(most)
    hot_cells = join_on(cells, F.broadcast(hot), [most])
    levels = F.broadcast(_largest_levels(hot_cells, fes, k, most, names, x)[most].select(most, F.col("__a").alias("__hot")))
    both = join_on(df, levels, [most], "left")
    cold = _taken_off(both.where(F.col("__hot").isNull()).drop("__hot"), cols, rest, names, x, by=most)
    return cold.unionByName(_taken_off(both.where(F.col("__hot").isNotNull()), cols, rest, names, x, also="__hot"))


def feols(df: DataFrame, y: str, xs: list[str], fes: list[str], *, name: str = "feols",
          cluster: str | None = None, singletons: bool = True) -> Fit:
    """ES2-ES5: OLS absorbing fixed effects, optional clustered errors; R² is the full-model R².  Regressors that the effects
    or the regressors before them give are left out and named."""
    keep = [y, *xs, *fes] + ([cluster] if cluster and cluster not in fes else [])
    # start from the narrow model frame, which is read several times
    d = stored(df.select(*keep).dropna(), "model")
    if singletons:
        d = drop_singletons(d, fes)
    raw = d.agg((F.sum(F.col(y) * F.col(y)) - F.sum(y) ** 2 / F.count(F.lit(1))).alias("t"),
                *[F.sum(F.col(x).cast("double") * F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).first()
    tss, scale = raw["t"], {x: raw[f"x{i}"] or 0.0 for i, x in enumerate(xs)}
    # read twice; where the tasks make it, its columns of doubles are far larger than the rows they are made of and are made again
    dm = demean(d, [y, *xs], fes)
    n_levels = d.agg(*[F.countDistinct(f).alias(f) for f in fes]).first().asDict()
    levels = sum(n_levels.values()) - (len(fes) - 1)
    nested = 0
    if cluster:
        # effects nested in the cluster are not counted in the small-sample factor
        for f in fes:
            if f == cluster or d.groupBy(f).agg(F.countDistinct(cluster).alias("c")).where("c > 1").isEmpty():
                nested += n_levels[f]
    fit = ols(dm, y, xs, name=name, intercept=False, cluster=cluster,
              absorbed_dof=levels - (nested if cluster else 0), tss_override=tss, scale=scale)
    return fit


def fitted_residuals(df: DataFrame, fit: Fit, y: str, keys: list[str],
                     intercept_name: str = "(Intercept)") -> DataFrame:
    """ES12: fitted value and residual per row id, coefficients as literals (no driver rows)."""
    pred = F.lit(0.0)
    for n, b in zip(fit.names, fit.beta):
        pred = pred + (F.lit(float(b)) if n == intercept_name else F.lit(float(b)) * F.col(n))
    return df.select(*keys, y, pred.alias("fitted")).withColumn("residual", F.col(y) - F.col("fitted"))


def fixed_effects(df: DataFrame, fit: Fit, y: str, fes: list[str], *, tol: float = 1e-10, max_rounds: int = 200,
                  direct: bool | None = None, seen: dict | None = None) -> dict[str, DataFrame]:
    """ES6: the fixed-effect values, effect -> (level, ``effect``, ``n_obs``, ``set_id``): the least-squares solution for what
    the fit leaves, balanced panel or not.  In each connected set of levels (``set_id``) the first effect carries the level
    and the others have mean zero (:func:`solve_levels`)."""
    left = F.col(y) - sum((F.lit(float(b)) * F.col(n) for n, b in zip(fit.names, fit.beta)), F.lit(0.0))
    cells = stored(cell_table(df.select(*fes, left.alias("__r")), ["__r"], fes), "cells")
    levels = solve_levels(cells, fes, 1, tol=tol, max_rounds=max_rounds, direct=direct, seen=seen)
    return {f: t.select(f, F.col("__a")[0].alias("effect"), F.col("__n").alias("n_obs"), F.col("__set").alias("set_id")) for f, t in levels.items()}


def stars(coef, se):
    """Significance marks: three above 2.576 standard errors (or without error), two above 1.96, one above 1.645."""
    t = F.abs(coef / se)
    return F.when((se == 0) | (t > 2.576), "***").when(t > 1.96, "**").when(t > 1.645, "*").otherwise("")


def model_table(coefs: DataFrame, models: list[str]) -> DataFrame:
    """ES19: coefficients by row, models by column: ``{model}`` the estimate with stars, ``{model}_se`` its standard error in
    brackets; NULL where a model lacks the coefficient."""
    e, s = F.col("estimate"), F.col("serr")
    cells = coefs.withColumn("__e", F.concat(F.format_string("%.3f", e), stars(e, s))).withColumn("__s", F.concat(F.lit("("), F.format_string("%.3f", s), F.lit(")")))
    return cells.groupBy("coef_name").agg(*[F.max(F.when(F.col("regression_name") == m, F.col(c))).alias(n)
                                            for m in models for c, n in (("__e", m), ("__s", m + "_se"))])


def event_terms(k: int, signs: tuple = ("pos", "neg"), prefix: str = "fee_chg") -> list[str]:
    """The regressors of an event study in their order: leads k to 1, the event, lags 1 to k, of each sign."""
    return [n for s in signs for n in [*[f"{prefix}_{s}_F{i}" for i in range(k, 0, -1)], f"{prefix}_{s}", *[f"{prefix}_{s}_L{i}" for i in range(1, k + 1)]]]


def event_study(quality: DataFrame, quantity: DataFrame, *, k: int = 12, week: str = "weekId", sub: str = "subId", user: str = "userId") -> list[Fit]:
    """ES7: the pre-trends check, with week and territory effects and errors clustered by territory: ln(1 + sats48) of
    posts (r1) and with the poster's effect (r2), ln(1 + posts) of weeks (r3) and with the growth control (r4)."""
    terms = event_terms(k)
    ql = quality.withColumn("log_sats48", F.log1p("sats48"))
    qn = quantity.withColumn("log_posts", F.log1p("n_posts"))
    return [feols(ql, "log_sats48", terms, [week, sub], cluster=sub, name="r1", singletons=False),
            feols(ql, "log_sats48", terms, [week, sub, user], cluster=sub, name="r2", singletons=False),
            feols(qn, "log_posts", terms, [week, sub], cluster=sub, name="r3", singletons=False),
            feols(qn, "log_posts", [*terms, "L12_growth"], [week, sub], cluster=sub, name="r4", singletons=False)]
