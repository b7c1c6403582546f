"""Act collapsing and windowed attribution (AG1-AG5, JN2, JN3).

Plan shape for attribution: events join parents on the item key (sort-merge or,
when Catalyst's size estimate allows it, broadcast of the parents), the time
predicate is applied right after the join, and the aggregation runs in two
levels -- first by (item, distinct key), then by item -- so a hot item's rows
are spread over tasks by the distinct key and pre-aggregated before the final
shuffle.  AQE splits a skewed join partition (``forceOptimizeSkewedJoin``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import not_failed
from ..functions.timefn import within_hours


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_acts(acts: DataFrame, keys: list[str], act_col: str, amount: Column | str,
                  tip_value: str = "TIP", fee_value: str = "FEE", state_col: str | None = None,
                  failed: str = "FAILED", time_name: str | None = None) -> DataFrame:
    """AG1: one row per (item, user, time) that has a tip: tip, fee, total and fee share.

    Groups with only fee rows are dropped (tips left-join fees); the share is
    NULL when the total is zero (0/0).
    """
    a = acts if state_col is None else acts.where(not_failed(state_col, failed))
    amt = _c(amount).cast("double")
    is_tip, is_fee = F.col(act_col) == tip_value, F.col(act_col) == fee_value
    g = (a.where(is_tip | is_fee).groupBy(*keys)  # other acts make no row and no sum
         .agg(F.count_if(is_tip).alias("__n_tip"),
              F.coalesce(F.sum(F.when(is_tip, amt)), F.lit(0.0)).alias("tip_sats"),
              F.coalesce(F.sum(F.when(is_fee, amt)), F.lit(0.0)).alias("fee_sats"))
         .where(F.col("__n_tip") > 0).drop("__n_tip")
         .withColumn("sats", F.col("tip_sats") + F.col("fee_sats"))
         .withColumn("sybil_rate", F.try_divide(F.col("fee_sats"), F.col("sats"))))
    if time_name:
        g = g.withColumnRenamed(keys[-1], time_name)
    return g


def collapse_single_act(acts: DataFrame, keys: list[str], act_col: str, amount: Column | str,
                        act_value: str, out: str, state_col: str | None = None,
                        failed: str = "FAILED") -> DataFrame:
    """AG2: one act type summed per (item, user, time) -- the downzaps table."""
    a = acts if state_col is None else acts.where(not_failed(state_col, failed))
    return (a.where(F.col(act_col) == act_value).groupBy(*keys)
            .agg(F.coalesce(F.sum(_c(amount).cast("double")), F.lit(0.0)).alias(out)))


def windowed_attribution(events: DataFrame, parents: DataFrame, *, event_key: str, parent_key: str,
                         event_time: str, parent_time: str, hours: float = 48,
                         lower_hours: float | None = None, sums: dict[str, Column | str] | None = None,
                         distinct: tuple[str, str] | None = None, count_name: str | None = None,
                         out_key: str | None = None) -> DataFrame:
    """AG3-AG5: per parent, totals of events at most ``hours`` after it.

    No lower bound unless ``lower_hours`` is given (N6: earlier events count).
    ``sums`` maps output name -> amount column; ``distinct`` is
    (output name, column) for a distinct count; ``count_name`` counts events.
    Returns one row per parent that has at least one event in the window.
    """
    near = in_window(events, parents, event_key=event_key, parent_key=parent_key, event_time=event_time,
                     parent_time=parent_time, hours=hours, lower_hours=lower_hours)
    return totals(near, event_key, sums=sums, distinct=distinct, count_name=count_name, out_key=out_key or parent_key)


def in_window(events: DataFrame, parents: DataFrame, *, event_key: str, parent_key: str, event_time: str,
              parent_time: str, hours: float = 48, lower_hours: float | None = None, carry: tuple = ()) -> DataFrame:
    """The events at most ``hours`` after a parent: a row for each such parent, with the parent's columns ``carry``.

    Raw acts may be cut so before they are collapsed (:func:`collapse_acts`): acts of one (item, user, time) are in the
    window together, and n parents of one key make n times the sum, as they do after it.  The acts then move once, and
    only those in the window are grouped, where the join left them.
    """
    p = parents.select(F.col(parent_key).alias("__pk"), F.col(parent_time).alias("__t0"), *carry)
    j = events.join(p, F.col(event_key) == F.col("__pk"))
    return j.where(within_hours(event_time, "__t0", hours, lower_hours)).drop("__pk", "__t0")


def totals(near: DataFrame, key: str, *, sums: dict[str, Column | str] | None = None, distinct: tuple[str, str] | None = None,
           count_name: str | None = None, out_key: str | None = None) -> DataFrame:
    """Sums, a distinct count and a count of the rows of :func:`in_window` by ``key`` (see :func:`windowed_attribution`)."""
    sums, out_key = sums or {}, out_key or key
    j = near.select(F.col(key).alias("__k"), *[_c(v).cast("double").alias(f"__s_{n}") for n, v in sums.items()],
                    *([F.col(distinct[1]).alias("__d")] if distinct else []))
    if distinct:
        lvl1 = (j.groupBy("__k", "__d")
                .agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums], F.count(F.lit(1)).alias("__n")))
        res = lvl1.groupBy("__k").agg(*[F.sum(f"__s_{n}").alias(n) for n in sums],
                                      F.count("__d").alias(distinct[0]),
                                      F.sum("__n").alias("__n"))
    else:
        res = j.groupBy("__k").agg(*[F.sum(f"__s_{n}").alias(n) for n in sums],
                                   F.count(F.lit(1)).alias("__n"))
    if count_name:
        res = res.withColumnRenamed("__n", count_name)
    else:
        res = res.drop("__n")
    return res.withColumnRenamed("__k", out_key)


def attach(df: DataFrame, measures: DataFrame, on: str | list[str], fill: dict | None = None) -> DataFrame:
    """JN2: left join measures and fill their defaults (0 for counts and sums)."""
    out = df.join(measures, on=on, how="left")
    if fill is None:
        keys = [on] if isinstance(on, str) else on
        fill = {c: 0 for c in measures.columns if c not in keys}
    return out.fillna(fill)
