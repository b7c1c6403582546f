"""Ordered scans split by size: running sums, decayed sums and as-of lookups over facts.

A window ``partitionBy(key).orderBy(time)`` puts a whole key in one task, and
buckets by calendar day put a hot day in one.  Here rows are dealt by
``repartitionByRange(key, time, tie-break)``, so every task gets about the same
number of rows whatever the key or the day, and sorted inside their partition:

1. each partition is scanned once in Arrow batches, with sums (or last values)
   that start afresh at its first row;
2. a second look at the same exchange gives one summary row a partition;
3. one task carries the summaries on from partition to partition (as many rows
   as there are partitions, whatever the data);
4. the carry comes back as a broadcast of that size.  Only the key that a
   partition begins with can have begun before it, so only its rows take it.

Both looks read one shuffle (the plan reuses the exchange), so facts are read
and moved once.  Should a plan ever run the exchange twice, with other bounds,
the partitions' first rows no longer agree and the query fails instead of
giving wrong sums.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefn import DAY_US  # noqa: F401  (buckets of the per-user scans in sequences)

_T = "__tmicros"
#: Cells of a wide matrix of sums that a task holds at a time.
_CELLS = 1 << 19
_MARKS = "__pid int, __origin long, __first int"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL (as it does in a grouping), so no row with a NULL key is lost."""
    names = {k: f"__k_{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(names)
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(r, cond, how).drop(*names.values())


# ---------------------------------------------------------------- partitions in order

def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in partitions of about the same size, each a range of ``order`` and sorted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows, cut to at most ``rows``."""
    for batch in batches:
        step = rows or max(1, batch.num_rows)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _row(batch: pa.RecordBatch, names: list[str], i: int) -> tuple:
    return tuple(_column(batch, c)[i].as_py() for c in names)


def changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns (the batch's first row: True); NULL equals NULL."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    out[0] = True
    for name in names:
        a = _column(batch, name)
        empty = np.asarray(a.is_null())
        differs = pc.fill_null(pc.not_equal(a.slice(1), a.slice(0, n - 1)), False)
        out[1:] |= np.asarray(differs) | (empty[1:] != empty[:-1])
    return out


def _starts(changed: np.ndarray, goes_on: bool) -> np.ndarray:
    """Per row, the index at which its run begins, or -1 if that was before the batch."""
    at = np.where(changed, np.arange(len(changed)), -1)
    if goes_on:
        at[0] = -1
    return np.maximum.accumulate(at)


class _Position:
    """Where a scan of one partition stands: its first row, and the key and time of the last row seen."""

    def __init__(self, by: list[str], order: list[str]):
        self.by, self.order = by, order
        self.origin = self.first_key = self.first_time = self.key = self.time = None
        self.one_key = self.one_time = True

    def step(self, batch: pa.RecordBatch):
        """(start of key run, start of time run, mark) of each row; mark 2: first key and time of the partition, 1: first key, 0: later."""
        key, time = _row(batch, self.by, 0), _column(batch, _T)[0].as_py()
        begins = self.origin is None
        if begins:
            self.origin = zlib.crc32(repr(_row(batch, self.order, 0)).encode())
            self.first_key, self.first_time = key, time
        same_key = not begins and key == self.key
        new_key = changes(batch, self.by)
        new_time = new_key | changes(batch, [_T])
        seg = _starts(new_key, same_key)
        grp = _starts(new_time, same_key and time == self.time)
        head = seg == (0 if begins else -1) if self.one_key else np.zeros(len(seg), bool)
        same = head & (grp == (0 if begins else -1)) if self.one_time else np.zeros(len(seg), bool)
        self.one_key, self.one_time = bool(head[-1]), bool(same[-1])
        last = batch.num_rows - 1
        self.key, self.time = _row(batch, self.by, last), _column(batch, _T)[last].as_py()
        return seg, grp, np.where(same, 2, np.where(head, 1, 0)).astype(np.int32)

    def ends(self) -> dict:
        return {"origin": self.origin, "first_key": self.first_key, "first_time": self.first_time, "key": self.key, "time": self.time,
                "one_key": self.one_key, "one_time": self.one_time}


def _carried(rows: DataFrame, read: list[str], summary: Callable[[Iterator[pa.RecordBatch]], dict | None],
             carry: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """One row a partition: its number, first row and what ``carry`` gives it from the summaries of those before."""
    def summaries(batches):
        got = summary(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(got)], pa.binary())],
                                             ["pid", "state"])

    def carries(batches):
        states = [(p, pickle.loads(s)) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        states.sort(key=lambda x: x[0])
        given = list(carry([s for _, s in states]))
        if given:
            kinds = [f.type for f in out][2:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in states], pa.int32()), pa.array([s["origin"] for _, s in states], pa.int64()),
                 *[pa.array(list(x), k) for x, k in zip(zip(*given), kinds)]], [f.name for f in out])

    from pyspark.sql.pandas.types import to_arrow_schema
    spark_schema = T.StructType.fromDDL(f"__cpid int, __corigin long, {schema}")
    out = to_arrow_schema(spark_schema)
    found = rows.select(*read).mapInArrow(summaries, "pid int, state binary")
    return found.repartition(1).mapInArrow(carries, spark_schema)


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows with the carry of their partition (one row a partition is broadcast)."""
    return rows.join(F.broadcast(carry), F.col("__pid") == F.col("__cpid"), "left")


def _agreed(column: str) -> Column:
    """A carry column, or an error where the two looks at a partition do not begin with the same row."""
    return F.when(F.col("__corigin") == F.col("__origin"), F.col(column)).otherwise(
        F.raise_error(F.lit("the two looks at an ordered partition differ: the exchange was not reused")))


def _marks(position: _Position, marks: np.ndarray) -> list:
    n = len(marks)
    return [pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.full(n, position.origin, np.int64)), pa.array(marks)]


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    flat = np.ascontiguousarray(matrix, dtype=np.float64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(flat))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    a = _column(batch, name)
    return np.asarray(a.flatten()).reshape(len(a), -1)


def _plus(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


# ---------------------------------------------------------------- running sums

def prefix_vectors(df: DataFrame, by: list[str], time_col: str, values: Column, *, tiebreak: list[str] | None = None,
                   strict: bool = False, expand: Callable[[np.ndarray], np.ndarray] | None = None, width: int = 0,
                   project: Column | None = None, groups: int = 1) -> DataFrame:
    """Add arrays ``__before`` (sums over the rows before this one in (time, tie-break) order) and, with ``strict``,
    ``__earlier`` (over rows of strictly earlier time) of a key's ``values``, an array of doubles.

    ``expand`` turns a batch's values into the matrix of ``width`` columns that is summed, so that wide sums need not
    leave the task; ``project`` then gives for each row the coefficients by which each of ``groups`` equal parts of its sums is added up.
    """
    order = [*by, _T, *(tiebreak or [])]
    d = df.withColumn(_T, F.unix_micros(F.col(time_col))).withColumn("__values", values)
    if project is not None:
        d = d.withColumn("__project", project)
    rows = in_order(d, order)
    wanted, projected = ["before", "earlier"] if strict else ["before"], project is not None
    schema = _plus(rows.schema, ", ".join([_MARKS, *[f"__in_{w} array<double>" for w in wanted]]))

    def matrix(batch):
        v = _matrix(batch, "__values")
        return v if expand is None else expand(v)

    def steps(batches):
        """(position, batch, its matrix, starts of key and time runs, marks) of each batch."""
        p = _Position(by, order)
        for batch in slices(batches, max(64, _CELLS // width) if width else 0):
            yield p, batch, matrix(batch), *p.step(batch)

    def sums_of(batch, m):
        """Sums as they leave the task."""
        if not projected:
            return m.astype(np.float64)
        return np.einsum("ngr,nr->ng", m.astype(np.float64).reshape(len(m), groups, -1), _matrix(batch, "__project"))

    def run(batches):
        total = earlier = None  # of the key that the last batch ended with, and of its times before the last
        for p, batch, v, seg, grp, marks in steps(batches):
            # 80-bit sums: taking off a run's start must not cost digits
            cs = np.zeros((len(v) + 1, v.shape[1]), np.longdouble)
            np.cumsum(v, axis=0, out=cs[1:], dtype=np.longdouble)
            before = cs[:-1]
            if seg[-1] > 0:  # else all rows are of the key that goes on or that begins here
                before = before - cs[np.maximum(seg, 0)]
            if seg[0] < 0:
                before[seg < 0] += total
            last = before[max(grp[-1], 0)] if grp[-1] >= 0 else earlier
            out = [sums_of(batch, before)]
            if strict:
                # only rows that share their time with the row before have other sums of earlier times
                at = np.flatnonzero(grp != np.arange(len(grp)))
                rest = before[np.maximum(grp[at], 0)]
                if grp[0] < 0:
                    rest[grp[at] < 0] = earlier
                strictly = out[0].copy()
                if len(at):
                    strictly[at] = sums_of(batch.take(pa.array(at)), rest)
                out.append(strictly)
            total, earlier = before[-1] + v[-1], last.copy()
            yield pa.RecordBatch.from_arrays([*batch.columns, *_marks(p, marks), *[_lists(m) for m in out]], names=[f.name for f in schema])

    def summary(batches):
        p = total = earlier = None
        for p, batch, v, seg, grp, _ in steps(batches):
            # the last row's key since it began, and its times before the last row's
            def added(until):
                part = v[max(seg[-1], 0):until].sum(axis=0, dtype=np.longdouble)
                return part + total if seg[-1] < 0 else part
            total, earlier = added(len(v)), added(grp[-1]) if grp[-1] >= 0 else earlier
        return None if p is None else p.ends() | {"total": total, "earlier": earlier}

    def carry(states):
        held = None
        for s in states:
            zero = np.zeros(len(s["total"]), np.longdouble)
            goes_on = held is not None and held[0] == s["first_key"]
            total = held[2] if goes_on else zero
            earlier = (held[3] if held[1] == s["first_time"] else held[2]) if goes_on else zero
            yield total.astype(float).tolist(), earlier.astype(float).tolist()
            if s["one_key"] and goes_on:
                before = held[3] if s["one_time"] and held[1] == s["time"] else held[2] + s["earlier"]
                held = (s["key"], s["time"], held[2] + s["total"], before)
            else:
                held = (s["key"], s["time"], s["total"], s["earlier"])

    carries = _carried(rows, rows.columns, summary, carry, "__total array<double>, __earlier array<double>")
    out = _with_carry(rows.mapInArrow(run, schema), carries)

    def together(w):
        given = F.when(F.col("__first") == 0, F.lit(None)).when((F.col("__first") == 2) & F.lit(w == "earlier"), _agreed("__earlier")).otherwise(
            _agreed("__total"))
        mine = F.col(f"__in_{w}")
        if projected:
            r = F.size("__project")
            parts = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.aggregate(
                F.zip_with(F.slice("__given", g * r + 1, r), F.col("__project"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
            # the carry's array is named once, so that it is not worked out again for every part
            return given, lambda: F.when(F.col("__given").isNull(), mine).otherwise(F.zip_with(mine, parts, lambda a, b: a + b))
        return given, lambda: F.when(F.col("__given").isNull(), mine).otherwise(F.zip_with(mine, "__given", lambda a, b: a + b))

    for w in wanted:
        given, value = together(w)
        out = out.withColumn("__given", given).withColumn(f"__sum_{w}", value())
    names = {"before": "__before", "earlier": "__earlier"}
    return out.select(*df.columns, *[F.col(f"__sum_{w}").alias(names[w]) for w in wanted])


def prefix_sums(df: DataFrame, by: list[str], time_col: str, values: dict[str, Column],
                *, strict: bool = True, tiebreak: list[str] | None = None, strict_suffix: str | None = None) -> DataFrame:
    """Add ``name = sum(value)`` over earlier rows of the same key.

    ``strict=True``: rows with time strictly before the current row (ties excluded).
    ``strict=False``: rows before the current one in (time, *tiebreak) order, so
    ties are split by the tie-break columns (rule N8); the current row is excluded.
    ``strict_suffix``: with ``strict=False``, also return the strict sums as
    ``name + strict_suffix`` from the same pass.
    """
    v = F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in values.values()])
    out = prefix_vectors(df, by, time_col, v, tiebreak=tiebreak, strict=strict or bool(strict_suffix))
    main = F.col("__earlier" if strict else "__before")
    res = [main[i].alias(n) for i, n in enumerate(values)]
    if strict_suffix and not strict:
        res += [F.col("__earlier")[i].alias(n + strict_suffix) for i, n in enumerate(values)]
    return out.select(*df.columns, *res)


# ---------------------------------------------------------------- decayed sums

def _decayed(values: np.ndarray, times: np.ndarray, runs: np.ndarray, rate: float) -> np.ndarray:
    """Inclusive decayed sums, each at its own row's time, inside runs: S_i = v_i + S_{i-1} e^{-rate (t_i - t_{i-1})}.

    Doubling steps: after step k a row holds its last 2^k rows.  All factors are at most 1, so nothing overflows
    however long the span, and a row's own value is always there undecayed."""
    out, step = values.copy(), 1
    while step < len(out):
        same = runs[step:] == runs[:-step]
        if not same.any():
            break
        factor = np.where(same, np.exp(-rate * np.where(same, times[step:] - times[:-step], 0.0)), 0.0)
        out[step:] += out[:-step].copy() * factor[:, None]
        step *= 2
    return out


def decayed_means(df: DataFrame, by: list[str], time_col: str, tiebreak: list[str], cat: str, y: str, categories: list,
                  half_life_s: float, out_prefix: str) -> DataFrame:
    """Add ``{prefix}{category}``: the mean of y over a key's earlier rows of the category (before in (time, tie-break)
    order), a row weighing half as much every ``half_life_s`` seconds; NULL where there is none.

    What is carried is (weighted sum, weight, time of the category's last row): the sums are as of that row, whose own
    weight is 1, so neither long spans nor short half-lives overflow or vanish, and two carries merge by decaying the
    earlier one to the later one's time.  A NULL y counts with weight and value 0, as elsewhere.
    """
    rate, k = float(np.log(2) / half_life_s), len(categories)
    code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(cat)), F.lit(0)).cast("int")
    order = [*by, _T, *tiebreak]
    d = (df.withColumn(_T, F.unix_micros(F.col(time_col))).withColumn("__code", code)
         .withColumn("__y", F.coalesce(F.col(y).cast("double"), F.lit(0.0))))
    rows = in_order(d, order)
    schema = _plus(rows.schema, f"{_MARKS}, __n array<double>, __d array<double>, __t array<double>")

    def scanned(batches):
        p = _Position(by, order)
        held = np.zeros((k, 2)), np.full(k, np.nan)  # sums and last time of each category in the current key
        for batch in slices(batches):
            seg, _, marks = p.step(batch)
            n = batch.num_rows
            codes, value = np.asarray(_column(batch, "__code")), np.asarray(_column(batch, "__y"))
            times = np.asarray(pc.fill_null(_column(batch, _T), 0)) / 1e6
            sums, last = np.zeros((n, k, 2)), np.full((n, k), np.nan)
            end = np.zeros((k, 2)), np.full(k, np.nan)
            for c in range(k):
                at = np.flatnonzero(codes == c + 1)
                goes_on = seg[0] < 0 and not np.isnan(held[1][c])
                v = np.column_stack((value[at], np.ones(len(at))))
                t, runs = times[at], seg[at]
                if goes_on:
                    v, t, runs = np.vstack((held[0][c], v)), np.append(held[1][c], t), np.append(-1, runs)
                s = _decayed(v, t, runs, rate)
                # the category's last row before each row, if it lies in the same key
                place = np.searchsorted(at, np.arange(n)) - 1 + goes_on
                has = place >= 0
                has[has] = runs[place[has]] == seg[has]
                sums[has, c], last[has, c] = s[place[has]], t[place[has]]
                if len(runs) and runs[-1] == seg[-1]:
                    end[0][c], end[1][c] = s[-1], t[-1]
            held = end
            p.held = held
            yield p, batch, marks, sums, last

    def run(batches):
        for p, batch, marks, sums, last in scanned(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_marks(p, marks), _lists(sums[:, :, 0]), _lists(sums[:, :, 1]), _lists(last)],
                                             names=[f.name for f in schema])

    def summary(batches):
        p = None
        for p, *_ in scanned(batches):
            pass
        return None if p is None else p.ends() | {"held": p.held}

    def carry(states):
        key, held = None, None
        for s in states:
            goes_on = held is not None and key == s["first_key"]
            sums, last = held if goes_on else (np.zeros((k, 2)), np.full(k, np.nan))
            yield sums[:, 0].tolist(), sums[:, 1].tolist(), last.tolist()
            new_sums, new_last = s["held"][0].copy(), s["held"][1].copy()
            if s["one_key"] and goes_on:
                none = np.isnan(new_last)
                decay = np.exp(-rate * (new_last - last))
                both = ~none & ~np.isnan(last)
                new_sums[both] += sums[both] * decay[both, None]
                new_sums[none], new_last[none] = sums[none], last[none]
            key, held = s["key"], (new_sums, new_last)

    carries = _carried(rows, rows.columns, summary, carry, "__cn array<double>, __cd array<double>, __ct array<double>")
    out = _with_carry(rows.mapInArrow(run, schema), carries)
    out = out.select("*", *[F.when(F.col("__first") > 0, _agreed(c)).alias("__use" + c[3:]) for c in ("__cn", "__cd", "__ct")])
    res = []
    for i, c in enumerate(categories):
        n, d_, t = F.col("__n")[i], F.col("__d")[i], F.col("__t")[i]
        cn, cd, ct = F.col("__usen")[i], F.col("__used")[i], F.col("__uset")[i]
        carried = F.coalesce(cd, F.lit(0.0)) > 0
        decay = F.when(carried, F.exp(F.lit(-rate) * (t - ct))).otherwise(0.0)
        both = (n + F.coalesce(cn, F.lit(0.0)) * decay) / (d_ + F.coalesce(cd, F.lit(0.0)) * decay)
        res.append(F.when(d_ > 0, both).when(carried, cn / cd).alias(f"{out_prefix}{c}"))
    return out.select(*df.columns, *res)


# ---------------------------------------------------------------- runs by gaps

def run_positions(df: DataFrame, by: list[str], time_col: str, tiebreak: list[str], gap_us: int, live: Column, out: str) -> DataFrame:
    """Add ``out``: how many live rows of its run come before a live row (NULL on the others, which do not count).

    A key's run goes on as long as each live row, in (time, tie-break) order, comes at most ``gap_us`` after the one before;
    a row without a time, or after one, begins a run.
    """
    order = [*by, _T, *tiebreak]
    rows = in_order(df.withColumn(_T, F.unix_micros(F.col(time_col))).withColumn("__live", live), order)
    schema = _plus(rows.schema, f"{_MARKS}, __at long, __open long")

    def scanned(batches):
        p = _Position(by, order)
        p.open = p.tail = None  # time the partition's first run begins at; (last time, rows) of the last key's last run
        seen = going = False  # whether a live row was met, and whether that first run still goes on
        for batch in slices(batches):
            seg, _, marks = p.step(batch)
            n = batch.num_rows
            at = np.flatnonzero(np.asarray(_column(batch, "__live")))
            t = _column(batch, _T)
            empty, times, runs = np.asarray(t.is_null())[at], np.asarray(pc.fill_null(t, 0))[at], seg[at]
            position, opened = np.zeros(n, np.int64), np.zeros(n, bool)
            if len(at):
                begins = np.ones(len(at), bool)
                begins[1:] = (runs[1:] != runs[:-1]) | empty[:-1] | empty[1:] | (times[1:] - times[:-1] > gap_us)
                if runs[0] < 0 and p.tail is not None and p.tail[0] is not None and not empty[0]:
                    begins[0] = times[0] - p.tail[0] > gap_us
                start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), -1))
                position[at] = np.arange(len(at)) - start
                held = start < 0
                if held[0]:
                    position[at[held]] += p.tail[1] - 1
                if not seen and marks[at[0]]:
                    p.open, first = None if empty[0] else int(times[0]), start == 0
                else:
                    first = held if going else np.zeros(len(at), bool)
                opened[at] = first
                seen, going = True, bool(first[-1])
            if len(at) and runs[-1] == seg[-1]:
                p.tail = (None if empty[-1] else int(times[-1]), int(position[at[-1]]) + 1)
            elif seg[-1] >= 0:
                p.tail, going = None, False
            p.going = going
            yield p, batch, marks, position, opened, at

    def run(batches):
        for p, batch, marks, position, opened, at in scanned(batches):
            dead = np.ones(batch.num_rows, bool)
            dead[at] = False
            since = pa.array(np.full(batch.num_rows, p.open or 0, np.int64), mask=~opened | (p.open is None))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_marks(p, marks), pa.array(position, mask=dead), since], names=[f.name for f in schema])

    def summary(batches):
        p = None
        for p, *_ in scanned(batches):
            pass
        return None if p is None else p.ends() | {"open": p.open, "tail": p.tail, "going": p.going}

    def carry(states):
        key, tail = None, None
        for s in states:
            goes_on = key is not None and key == s["first_key"]
            known = goes_on and tail is not None and tail[0] is not None
            yield tail if known else (None, None)
            mine = s["tail"]
            if s["one_key"] and goes_on:
                if mine is None:
                    mine = tail
                elif known and s["going"] and s["open"] is not None and s["open"] - tail[0] <= gap_us:
                    mine = (mine[0], mine[1] + tail[1])
            key, tail = s["key"], mine

    carries = _carried(rows, rows.columns, summary, carry, "__ctime long, __crows long")
    found = _with_carry(rows.mapInArrow(run, schema), carries)
    more = F.when(F.col("__open").isNotNull() & (F.col("__open") - _agreed("__ctime") <= F.lit(gap_us)), F.col("__crows"))
    return found.select(*df.columns, (F.col("__at") + F.coalesce(more, F.lit(0))).alias(out))


# ---------------------------------------------------------------- as-of lookups

def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              cols: list[str], *, truncate_seconds: bool = False, right_order: list[str] | None = None) -> DataFrame:
    """Backward as-of join: each left row gets ``cols`` of the latest right row with
    the same ``by`` keys and ``right_on <= left_on`` (exact time matches allowed).

    Right rows sharing a time are ordered by ``right_order`` (default ``cols``)
    and the last wins.  ``truncate_seconds`` compares both times cut to whole
    seconds, as the owner lookup does (N14); the left time column is then
    returned truncated.
    """
    lt = F.date_trunc("second", F.col(left_on)) if truncate_seconds else F.col(left_on)
    rt = F.date_trunc("second", F.col(right_on)) if truncate_seconds else F.col(right_on)
    lcols = [c for c in left.columns]
    if truncate_seconds:
        left = left.withColumn(left_on, lt)
    r_order = right_order or cols
    rstruct = F.struct(*[F.col(c) for c in cols])
    L = left.select(*[F.col(k) for k in by], F.unix_micros(F.col(left_on)).alias(_T), F.lit(1).alias("__side"),
                    F.struct(*[F.col(c) for c in lcols]).alias("__l"),
                    F.lit(None).cast(rstruct_type(right, cols)).alias("__r"),
                    F.lit(None).cast(order_type(right, r_order)).alias("__ro"))
    R = right.select(*[F.col(k) for k in by], F.unix_micros(rt).alias(_T), F.lit(0).alias("__side"),
                     F.lit(None).cast(L.schema["__l"].dataType).alias("__l"),
                     rstruct.alias("__r"), F.struct(*[F.col(c) for c in r_order]).alias("__ro"))
    order = [*by, _T, "__side", "__ro"]
    # left rows that share a time would all be one range without a column of their own
    rows = in_order(L.unionByName(R).withColumn("__spread", F.when(F.col("__side") == 1, F.xxhash64("__l"))), [*order, "__spread"])
    kind = rows.schema["__r"].dataType
    schema = _plus(T.StructType([rows.schema["__l"], T.StructField("__hit", kind)]), _MARKS)

    def scanned(batches):
        p, held = _Position(by, [*by, _T, "__side"]), None
        for batch in slices(batches):
            seg, _, marks = p.step(batch)
            n = batch.num_rows
            r, side = _column(batch, "__r"), np.asarray(_column(batch, "__side"))
            hit = np.maximum.accumulate(np.where(side == 0, np.arange(n), -1))
            own = (hit >= 0) & (hit >= seg)
            index = np.where(own, hit, -1)
            if held is not None:
                index[~own & (seg < 0)] = n
                r = pa.concat_arrays([r, held])
            last = int(index[-1])
            held = None if last < 0 else r.slice(last, 1)
            p.held = held
            yield p, batch, marks, r, index, side

    def run(batches):
        for p, batch, marks, r, index, side in scanned(batches):
            keep = pa.array(np.flatnonzero(side == 1))
            taken = r.take(pa.array(index, mask=index < 0).take(keep))
            yield pa.RecordBatch.from_arrays([_column(batch, "__l").take(keep), taken, *[m.take(keep) for m in _marks(p, marks)]],
                                             names=[f.name for f in schema])

    def summary(batches):
        p = None
        for p, *_ in scanned(batches):
            pass
        return None if p is None else p.ends() | {"held": None if p.held is None else p.held[0].as_py()}

    def carry(states):
        key, held = None, None
        for s in states:
            goes_on = key is not None and key == s["first_key"]
            yield (held if goes_on else None,)
            held = s["held"] if s["held"] is not None or not (s["one_key"] and goes_on) else held
            key = s["key"]

    carries = _carried(rows, rows.columns, summary, carry, f"__last {kind.simpleString()}")
    out = _with_carry(rows.mapInArrow(run, schema), carries)
    found = F.coalesce("__hit", F.when(F.col("__first") > 0, _agreed("__last")))
    return out.select("__l.*", found.alias("__m")).select(*[F.col(c) for c in lcols], *[F.col("__m")[c].alias(c) for c in cols])


def rstruct_type(df: DataFrame, cols: list[str]):
    return df.select(F.struct(*[F.col(c) for c in cols]).alias("s")).schema["s"].dataType


def order_type(df: DataFrame, cols: list[str]):
    return rstruct_type(df, cols)


def backfill(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """WN3: fill NULLs from the next non-null value of the same key (leading NULLs too).

    Meant for panels, whose rows per key are bounded by the calendar span.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    for c in cols:
        df = df.withColumn(c, F.first(c, ignorenulls=True).over(w))
    return df
