"""Streaming queries (optional extras): run over the test files with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as attr
from ..sources.tables import Tables
from ..streaming import jobs
from .q_joins import D, SATS48_SQL
from .registry import r6, register


@register("stream_ag3_interval_join", SATS48_SQL.format(cond=f"{D} <= {30 * 24 * 3600 * 1000000} AND {D} >= 0"))
def stream_ag3(spark, d):
    z = jobs.table_stream(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    p = jobs.table_stream(spark, d, "orders").select("o_orderkey", "o_orderdate")
    pairs = jobs.attribution_pairs(z, p, zap_key="l_orderkey", zap_time="l_shipdate", post_key="o_orderkey",
                                   post_time="o_orderdate", hours=30 * 24, lower_hours=0, watermark="3 days")
    out = spark.read.parquet(jobs.run_available_now(pairs))
    m = (out.groupBy(F.col("l_orderkey").alias("o_orderkey"))
         .agg(F.sum("l_extendedprice").alias("sats48"), F.countDistinct("l_suppkey").alias("zappers48")))
    res = attr.attach(Tables(spark, d).orders.select("o_orderkey"), m, "o_orderkey", {"sats48": 0.0, "zappers48": 0})
    return res.select("o_orderkey", r6("sats48").alias("sats48"), "zappers48")


@register("stream_wn1_burst_sessions", """
WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
           FROM events WHERE event_type <> 'error'),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + to_microseconds(21600000001) AS session_end, COUNT(*) AS n_acts
FROM s GROUP BY user_id, sess
""")
def stream_wn1_sessions(spark, d):
    e = jobs.table_stream(spark, d, "events").where(F.col("event_type") != "error")
    s = jobs.burst_sessions(e.select("user_id", "ts"), "user_id", "ts", 6 * 3600)
    out = jobs.run_complete(s)
    return out.select("user_id", F.col("session.start").alias("session_start"),
                      F.col("session.end").alias("session_end"), "n_acts")
