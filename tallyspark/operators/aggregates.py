"""Aggregation templates (AG7, AG8, AG13, AG19, AG22, AG23).

All are partial-aggregate friendly: per-key reductions first, then tiny
per-bin or per-key tables.  Where a window runs without a partition key it is
over an already aggregated table whose size is set by parameters (bins,
categories), never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_birth(declared: DataFrame, activity: DataFrame, key: str, declared_time: str, activity_time: str,
                 out: str = "created_at") -> DataFrame:
    """AG7: birth = the earlier of the declared time and the first activity, per declared entity."""
    first = activity.groupBy(key).agg(F.min(activity_time).alias("__first"))
    return (declared.join(first, key, "left")
            .withColumn(out, F.least(F.col(declared_time), F.col("__first"))).drop("__first"))


def ownership_history(entities: DataFrame, transfers: DataFrame, key: str = "subName",
                      created: str = "created_at", owner: str = "currentOwner", t_time: str = "created_at",
                      old: str = "oldUserId", new: str = "newUserId") -> DataFrame:
    """AG8: one synthetic first-owner row per entity plus one row per transfer.

    The first owner is the first transfer's old owner, or the current owner
    when the entity never changed hands.
    """
    first_old = transfers.groupBy(key).agg(F.min_by(old, F.struct(t_time, old)).alias("__first_old"))
    synth = (entities.join(first_old, key, "left")
             .select(F.col(created).alias("timeStamp"), key, F.lit(0).cast("bigint").alias("userIdFrom"),
                     F.coalesce("__first_old", owner).cast("bigint").alias("userIdTo")))
    moves = transfers.select(F.col(t_time).alias("timeStamp"), key, F.col(old).cast("bigint").alias("userIdFrom"),
                             F.col(new).cast("bigint").alias("userIdTo"))
    return synth.unionByName(moves)


def ordered_list(df: DataFrame, key: str, item: str, priority: str, out_prefix: str = "") -> DataFrame:
    """AG13/TK6: per key, distinct items sorted by (priority, item): first, joined list, count.

    Meant for small per-key domains (wallets, categories): the list is the output.
    """
    g = df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(priority).alias("p"),
                                                                 F.col(item).alias("i")))).alias("__s"))
    items = F.transform("__s", lambda s: s["i"].cast("string"))
    return g.select(key, F.element_at("__s", 1)["i"].alias(out_prefix + "main"),
                    F.concat_ws(",", items).alias(out_prefix + "all"), F.size("__s").alias(out_prefix + "n"))


def share_histogram(df: DataFrame, value: Column, amount: Column, cap: int, upto: int) -> DataFrame:
    """AG19: share of total amount by capped bin, and the cumulative share up to ``upto``.

    The global window runs over at most ``cap`` + (number of lower bins) rows.
    """
    b = (df.select(F.least(value, F.lit(cap)).alias("bin"), amount.cast("double").alias("__a"))
         .groupBy("bin").agg(F.sum("__a").alias("__s")))
    tot = Window.partitionBy()
    cum = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (b.withColumn("share", F.col("__s") / F.sum("__s").over(tot))
            .withColumn("cum_share", F.sum(F.when(F.col("bin") <= upto, F.col("__s"))).over(cum)
                        / F.sum("__s").over(tot))
            .drop("__s"))


def group_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG23: mean, count, sample std and standard error per group."""
    return (df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"),
                                F.stddev_samp(value).alias("std"))
            .withColumn("se", F.col("std") / F.sqrt("n")))
