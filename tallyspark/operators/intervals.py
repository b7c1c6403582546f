"""Interval joins without range-join blow-up (JN7, JN8).

Contiguous spells (each ends where the next starts, the last at the data end)
partition the time line, so "count events with start <= t < end" is an as-of
assignment of each event to its spell followed by a group-by: linear work and
skew-safe through :func:`scan.asof_join`, never a theta join.  Calendar ranges
that align with a calendar bucket ([week, week + 7 d)) are an equi-group on
the bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def count_in_contiguous_spells(spells: DataFrame, points: DataFrame, by: list[str], start: str, end: str,
                               t: str, out: str, sums: dict[str, Column] | None = None) -> DataFrame:
    sums = sums or {}
    tagged = scan.asof_join(points, spells.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e")),
                            by, t, "__s", ["__s", "__e"])
    inside = tagged.where(F.col("__s").isNotNull() & (F.col(t) < F.col("__e")))
    agg = (inside.groupBy(*by, F.col("__s").alias(start))
           .agg(F.count(F.lit(1)).alias(out), *[v.alias(k) for k, v in sums.items()]))
    res = spells.join(agg, on=by + [start], how="left")
    return res.fillna({out: 0})


def calendar_bucket_aggregate(df: DataFrame, time_col: str, bucket: Callable[[Column], Column],
                              aggs: dict[str, Column], out_name: str) -> DataFrame:
    return df.groupBy(bucket(F.col(time_col)).alias(out_name)).agg(*[v.alias(k) for k, v in aggs.items()])
