"""Panels: key x calendar skeletons and row-window rolling sums (JN9, WN4, WN5).

The skeleton is generated per key from its own first period to the data end
(``explode(sequence(...))``), so nothing is built only to be dropped and no
keys x calendar cross join is formed.  Rows per key are bounded by the
calendar span, which is what makes per-key windows over a panel skew-safe.

A whole panel is many times its input (most periods hold nothing), so
:func:`filled` shuffles and sorts the input alone and makes the panel's rows in
the tasks, in order, with what has to be known from the key's rows around them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timefn as tf
from . import scan

#: Rows of a panel that a task makes at a time.
_ROWS = 1 << 16


def spans(df: DataFrame, key: str, time_col: str, step: str = "day", end=None) -> DataFrame:
    """A key's first and last period (``__first``, ``__last``), one row a key."""
    trunc = tf.as_date if step == "day" else tf.as_week
    firsts = df.groupBy(key).agg(trunc(F.min(time_col)).alias("__first"))
    if end is None:
        last = df.agg(trunc(F.max(time_col)).alias("__last"))
        firsts = firsts.crossJoin(F.broadcast(last))  # one row
    else:
        firsts = firsts.withColumn("__last", trunc(F.lit(end).cast("timestamp")))
    return firsts.where(F.col("__first") <= F.col("__last"))


def skeleton(df: DataFrame, key: str, time_col: str, step: str = "day", end=None,
             out: str | None = None) -> DataFrame:
    return periods(spans(df, key, time_col, step, end), key, step, out or step)


def periods(spans_df: DataFrame, key: str, step: str, out: str) -> DataFrame:
    """The skeleton of the spans: a row for each of a key's periods."""
    days = 1 if step == "day" else 7
    seq = F.sequence("__first", "__last", F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days)))
    return spans_df.select(key, F.explode(seq).alias(out))


def filled(spans_df: DataFrame, sums: DataFrame, key: str, step: str, out: str,
           add: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, pa.Array]], ddl: str, columns: list[str] | None = None) -> DataFrame:
    """The panel of the spans: (key, period), the sums of the period (0 without any), columns that the spans carry
    and those that ``add`` (of types ``ddl``) makes of the sums and of each row's number in its key.

    Spans and sums are dealt by key and sorted; a task makes the keys' rows in order.  ``sums`` has one row a key and
    period, in long or double columns; those of no key, or of a period outside the key's span, are left out.  A NULL
    number as the spans' key becomes 0, without sums; its rows come before those of a key 0 with the same period.  ``columns``: those wanted beside key and period, as Spark cannot
    leave out columns that a task makes.
    """
    days = 1 if step == "day" else 7
    carried = [c for c in spans_df.columns if c not in (key, "__first", "__last")]
    values = [c for c in sums.columns if c not in (key, out)]
    s = (spans_df.withColumn("__kind", F.col(key).isNotNull().cast("int")).fillna(0, subset=[key])
         .withColumnRenamed("__first", "__at"))
    d = s.unionByName(sums.where(F.col(key).isNotNull()).fillna(0).withColumnRenamed(out, "__at").withColumn("__kind", F.lit(2)),
                      allowMissingColumns=True)
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.repartition(n, key).sortWithinPartitions(key, "__kind", "__at")
    fields = {f.name: f for f in rows.schema}
    schema = T.StructType([fields[key], T.StructField(out, T.DateType()), *[fields[c] for c in values], *T.StructType.fromDDL(ddl).fields,
                           *[fields[c] for c in carried]])
    if columns is not None:
        schema = T.StructType([f for f in schema if f.name in (key, out, *columns)])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def made(table, begins, at, last, kind, new):
        """The rows of whole keys, which start where ``new``; the rows ``begins`` are the spans."""
        first, size = at[begins], (last[begins] - at[begins]) // days + 1
        start = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(start, size)
        mine = np.cumsum(np.bincount(begins, minlength=len(at))) - 1  # the span before each row
        off = at - first[mine]
        has = (kind == 2) & (kind[begins][mine] == 1) & (off >= 0) & (off % days == 0) & (off // days < size[mine])
        to = start[mine[has]] + off[has] // days
        got = {}
        for c in values:
            v = np.asarray(scan._column(table, c))
            got[c] = np.zeros(len(place), v.dtype)
            got[c][to] = v[has]
        source, dates = np.repeat(begins, size), np.repeat(first, size) + place * days
        if not new[begins].all():  # two spans of a key
            of_key = np.repeat(np.cumsum(new)[begins], size)
            order = np.lexsort((dates, of_key))
            source, dates, got = source[order], dates[order], {c: v[order] for c, v in got.items()}
            place = np.arange(len(place)) - np.searchsorted(of_key, of_key)
        source, dates = pa.array(source), pa.array(dates.astype(np.int32)).cast(pa.date32())
        columns = {key: scan._column(table, key).take(source), out: dates, **{c: pa.array(v) for c, v in got.items()}, **add(got, place),
                   **{c: scan._column(table, c).take(source) for c in carried}}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    def pieces(table):
        """(rows of whole keys in portions of about ``_ROWS`` made rows)"""
        kind = np.asarray(scan._column(table, "__kind"))
        at, last = (np.asarray(scan._column(table, c).cast(pa.int32()).fill_null(0)).astype(np.int64) for c in ("__at", "__last"))
        new = scan.changes(table, [key])
        # sums without a span before them belong to no key
        keep = kind < 2
        keep |= np.maximum.accumulate(np.where(kind < 2, np.arange(len(kind)), -1)) >= np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
        if not keep.all():
            kept = np.flatnonzero(keep)
            table, kind, at, last, new = table.take(pa.array(kept)), kind[kept], at[kept], last[kept], new[kept]
        begins = np.flatnonzero(kind < 2)
        if not len(begins):
            return
        heads = new[begins]
        portion = (np.cumsum((last[begins] - at[begins]) // days + 1) // _ROWS)[heads]
        cuts = [*begins[heads][np.flatnonzero(np.diff(portion, prepend=-1))], len(kind)]
        for a, b in zip(cuts, cuts[1:]):
            own = begins[(begins >= a) & (begins < b)] - a
            yield made(table.slice(a, b - a), own, at[a:b], last[a:b], kind[a:b], new[a:b])

    def run(batches):
        held = None
        for batch in scan.slices(batches):
            if held is not None:
                batch = pa.concat_batches([held, batch])
            whole = int(np.flatnonzero(scan.changes(batch, [key]))[-1])  # the last key may go on
            if whole:
                yield from pieces(batch.slice(0, whole))
            held = batch.slice(whole)
        if held is not None:
            yield from pieces(held)

    return rows.mapInArrow(run, schema)


def rolling_sums_along(values: dict[str, np.ndarray], place: np.ndarray, window: int, lag: int = 0,
                       prefix: str = "rolling_") -> dict[str, pa.Array]:
    """:func:`rolling_sum` of columns without NULLs in rows in order, ``place`` being a row's number in its key."""
    short = place < window - 1 + lag
    out = {}
    for c, v in values.items():
        total = np.zeros(len(v), v.dtype)
        for back in range(window - 1 + lag, lag - 1, -1):  # the earliest first, as a window adds up
            total[back:] += v[:max(len(v) - back, 0)]
        out[prefix + c] = pa.array(total, mask=short)
    return out


def rolling_sum(df: DataFrame, by: list[str], order: list[str], cols: list[str], window: int,
                lag: int = 0, prefix: str = "rolling_") -> DataFrame:
    """Sum of ``window`` rows ending ``lag`` rows before the current one, per key.

    NULL until the window is full (rule N7); never rolls across keys.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1) - lag, -lag)
    for c in cols:
        full = F.count(F.col(c)).over(w) == window
        df = df.withColumn(prefix + c, F.when(full, F.sum(c).over(w)))
    return df


def keep_groups_with_total(df: DataFrame, by: list[str], col: str, min_exclusive: float = 0) -> DataFrame:
    """WN5: keep keys whose total of ``col`` exceeds ``min_exclusive``."""
    w = Window.partitionBy(*by)
    return df.withColumn("__tot", F.sum(col).over(w)).where(F.col("__tot") > min_exclusive).drop("__tot")
